import hashlib
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from lorekeeper.llm import exact_dedup, line_dedup, ngram_join

from .conftest import odd_texts

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def brute_exact(rows):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(rows):
        plain = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(t or ""), i is None, i or 0, n, i))
    out = Counter()
    for sha, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out[m[4], members[0][4], len(members), k == 0, sha] += 1
    return out


def test_exact_groups(odd, none):
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert counted(exact_dedup.exact_groups(odd), *cols) == brute_exact([(i, t) for i, t, _, _ in odd_texts()])
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_drop(odd, none):
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _, _ in odd_texts()})
    assert exact_dedup.drop_exact_copies(none).count() == 0


def test_many_copies_in_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'copy' else concat('t', id % 700) end as text").repartition(50)
    got = counted(exact_dedup.exact_groups(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact([(i, "copy" if i % 3 == 0 else f"t{i % 700}") for i in range(3000)])


def brute_lines(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(UP)

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            ids = held.get(key(line), ())
            keeper = max((x for x in ids if x is not None), default=None)
            if len(ids) < 3 or i == keeper:
                keep.append(line)
        out[i, len(lines), len(lines) - len(keep), "\n".join(keep)] += 1
    return out


def test_lines(odd, none):
    got = line_dedup.dedup_lines(odd)
    assert set(odd.columns) < set(got.columns)
    assert counted(got, "doc_id", "n_lines", "n_dropped", "kept_text") == brute_lines([(i, t) for i, t, _, _ in odd_texts()])
    assert line_dedup.dedup_lines(none).count() == 0


def test_many_shared_lines_take_linear_time(spark):
    shared = "\n".join(f"this is shared line number {i}" for i in range(100_000))
    docs = spark.createDataFrame([(i, f"{shared}\nend {i}") for i in range(3)], "doc_id long, text string")
    began = time.time()
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_text[-5:], len(r.kept_text) > 10) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {(0, 100_001, 100_000, "end 0", False), (1, 100_001, 100_000, "end 1", False), (2, 100_001, 0, "end 2", True)}
    assert time.time() - began < 60


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_similar(rows, k, similarity):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * similarity.denominator >= similarity.numerator * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)] = min(i, least.get(find(n), i))
    return Counter((i, len(sets[n]), least.get(find(n))) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "similarity"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_similar_groups(odd, k, similarity):
    got = counted(ngram_join.similar_groups(odd, k, similarity), "doc_id", "n_shingles", "component_id")
    assert got == brute_similar([(i, t) for i, t, _, _ in odd_texts()], k, similarity)


def test_similar_chain(spark):
    """Documents of which each links with its neighbours only, and boundary cases of the threshold."""
    words = [f"w{i}" for i in range(400)]
    rows = []
    for step in range(40):
        own = list(words)
        for j in range(step):
            own[(j * 7) % 400] = f"s{j}"
        rows.append((100 + step, " ".join(own)))
    rows += [(500 + n, " ".join(f"q{j}" for j in range(n))) for n in range(8, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = counted(ngram_join.similar_groups(docs, 3, Fraction(9, 10)), "doc_id", "n_shingles", "component_id")
    assert got == brute_similar(rows, 3, Fraction(9, 10))


def test_similar_empty_and_drop(odd, none):
    assert ngram_join.similar_groups(none).count() == 0
    left = ngram_join.drop_similar(odd)
    assert left.columns == odd.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[7] == 1 and ids[8] == ids[9] == ids[10] == 0 and ids[11] == 1 and ids[20] == 2 and ids[None] == 1
    assert ngram_join.drop_similar(none).count() == 0


def test_rtree_finds_what_a_scan_finds():
    import numpy as np

    rng = np.random.default_rng(3)
    points = rng.poisson(3, (500, 16))
    points[100:200] = points[:100] + (rng.random((100, 16)) < 0.05)
    tree = ngram_join.RTree(points)
    for q in points[:150]:
        need = ngram_join._needed(points.sum(axis=1), int(q.sum()), Fraction(9, 10))
        want = np.flatnonzero(np.minimum(points, q).sum(axis=1) >= need)
        assert sorted(tree.search(q, Fraction(9, 10)).tolist()) == want.tolist()
