"""Aggregation pipelines: a list of whitelisted stages applied to a DataFrame.

Each stage is one DataFrame operation; Catalyst optimises what they add up to.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, NullType, StructType

from .search import vector_search
from .traversal import graph_lookup, graph_lookup_each

#: Rows that a pipeline returns at most, and hops that a lookup goes.
MAX_RESULTS, MAX_DEPTH = 100, 5
_PLACE = "__place"
_MISSING = {"$literal": None}


class PipelineError(ValueError):
    """A stage, operator or field that pipelines do not allow."""


def field(path: str) -> Column:
    """A field by dotted path; a missing key of a map is null."""
    head, *rest = path.split(".")
    return reduce(lambda c, k: c[k], rest, F.col(head))


def _known(kind: DataType, path: str) -> bool:
    """Whether a dotted path leads to a field of the schema; what a map holds is known only to its rows."""
    for key in path.split("."):
        while isinstance(kind, ArrayType):
            kind = kind.elementType
        if isinstance(kind, MapType):
            return True
        if not isinstance(kind, StructType) or key not in kind.fieldNames():
            return False
        kind = kind[key].dataType
    return True


def _with_missing(e, schema: StructType):
    """An expression in which fields that no row has are null."""
    if isinstance(e, str) and e.startswith("$") and not e.startswith("$$"):
        return e if _known(schema, e[1:]) else _MISSING
    if isinstance(e, list):
        return [_with_missing(x, schema) for x in e]
    if isinstance(e, dict) and "$literal" not in e:
        return {k: _with_missing(v, schema) for k, v in e.items()}
    return e


def _resolved(name: str, a, schema: StructType):
    """A stage's argument in which fields that no row has are null: they sort nothing and unwind to nothing."""
    if name == "$match":
        return {k: _with_missing(v, schema) if k == "$expr" else [_resolved(name, q, schema) for q in v] if k in ("$and", "$or", "$nor") else v for k, v in a.items()}
    if name == "$sort":
        return {k: v for k, v in a.items() if _known(schema, k)}
    if name == "$project":
        return {k: _MISSING if v in (1, True) and not isinstance(v, dict) and not _known(schema, k) else _with_missing(v, schema) for k, v in a.items()}
    if name in ("$addFields", "$group", "$sortByCount", "$bucket", "$bucketAuto", "$redact", "$graphLookup"):
        return _with_missing(a, schema)
    return a


def expression(e) -> Column:
    """A computed value: ``$field``, a literal, or one operator with its arguments."""
    if e == "$$ROOT":
        return F.struct("*")
    if isinstance(e, str) and e.startswith("$"):
        return field(e[1:])
    if not isinstance(e, dict):
        return F.lit(e)
    (op, args), = e.items()
    if op == "$literal":
        return F.lit(args)
    if op == "$cond":
        parts = args if isinstance(args, list) else [args["if"], args["then"], args["else"]]
        a, b, c = map(expression, parts)
        return F.when(a, b).otherwise(c)
    values = [expression(x) for x in (args if isinstance(args, list) else [args])]
    if op not in _OPERATORS:
        raise PipelineError(f"unknown operator {op}")
    return _OPERATORS[op](*values)


_OPERATORS: dict[str, Callable[..., Column]] = {
    "$add": lambda *x: reduce(Column.__add__, x),
    "$subtract": lambda a, b: a - b,
    "$multiply": lambda *x: reduce(Column.__mul__, x),
    "$divide": lambda a, b: a / b,
    "$eq": lambda a, b: a.eqNullSafe(b),
    "$ne": lambda a, b: ~a.eqNullSafe(b),
    "$gt": lambda a, b: a > b,
    "$gte": lambda a, b: a >= b,
    "$lt": lambda a, b: a < b,
    "$lte": lambda a, b: a <= b,
    "$and": lambda *x: reduce(Column.__and__, x),
    "$or": lambda *x: reduce(Column.__or__, x),
    "$not": lambda a: ~a,
    "$ifNull": lambda *x: F.coalesce(*x),
    "$concat": lambda *x: F.concat(*x),
    "$toLower": F.lower,
    "$toUpper": F.upper,
    "$strLenCP": F.length,
    "$size": F.size,
    "$setUnion": lambda *x: reduce(F.array_union, x),
    "$slice": lambda a, n: F.slice(a, F.lit(1), n),
    "$mergeObjects": lambda *x: F.map_concat(*x),
    "$max": lambda *x: F.greatest(*x),
    "$min": lambda *x: F.least(*x),
}


def predicate(query: dict, columns: list[str] | None = None) -> Column:
    """A filter; null and missing are one, so ``{field: None}`` matches both.

    With ``columns`` a field that is none of them is null.
    """
    value = lambda k: field(k) if columns is None or k.split(".")[0] in columns else F.lit(None)
    tests = []
    for key, want in query.items():
        if key in ("$and", "$or", "$nor"):
            each = [predicate(q, columns) for q in want]
            tests.append(reduce(Column.__and__, each) if key == "$and" else reduce(Column.__or__, each) if key == "$or" else ~reduce(Column.__or__, each))
        elif key == "$expr":
            tests.append(expression(want))
        elif key.startswith("$"):
            raise PipelineError(f"unknown operator {key}")
        elif isinstance(want, dict) and any(k.startswith("$") for k in want):
            tests += [_test(value(key), op, v) for op, v in want.items()]
        else:
            tests.append(value(key).eqNullSafe(F.lit(want)))
    return reduce(Column.__and__, [F.coalesce(t, F.lit(False)) for t in tests], F.lit(True))


def _test(c: Column, op: str, v) -> Column:
    if op == "$not":
        return ~reduce(Column.__and__, [F.coalesce(_test(c, k, x), F.lit(False)) for k, x in v.items()])
    if op in ("$in", "$nin"):
        some = [x for x in v if x is not None]
        found = F.coalesce(c.isin(*some), F.lit(False)) | (c.isNull() if None in v else F.lit(False))
        return found if op == "$in" else ~found
    tests: dict[str, Callable[[], Column]] = {
        "$eq": lambda: c.eqNullSafe(F.lit(v)),
        "$ne": lambda: ~c.eqNullSafe(F.lit(v)),
        "$gt": lambda: c > v,
        "$gte": lambda: c >= v,
        "$lt": lambda: c < v,
        "$lte": lambda: c <= v,
        "$exists": lambda: c.isNotNull() if v else c.isNull(),
        "$size": lambda: F.size(c) == v,
        "$regex": lambda: F.rlike(c, F.lit(v)),
    }
    if op not in tests:
        raise PipelineError(f"unknown operator {op}")
    return tests[op]()


def _match(df: DataFrame, a: dict, _) -> DataFrame:
    return df.where(predicate(a, df.columns))


def _sort(df: DataFrame, a: dict, context: dict) -> DataFrame:
    """Ordered rows; a later ``$group`` takes its first and last rows in this order."""
    context["order"] = a
    return df.orderBy(*_order(a)) if a else df


def _project(df: DataFrame, a: dict, _) -> DataFrame:
    gone = [k for k, v in a.items() if v in (0, False) and not isinstance(v, dict)]
    kept = [(k, v) for k, v in a.items() if k not in gone]
    if gone and kept and gone != ["_id"]:
        raise PipelineError("a projection includes or excludes, not both")
    if not kept:
        return df.drop(*gone)
    return df.select(*[(field(k) if v in (1, True) and not isinstance(v, dict) else expression(v)).alias(k) for k, v in kept])


def _add_fields(df: DataFrame, a: dict, _) -> DataFrame:
    return df.withColumns({k: expression(v) for k, v in a.items()})


def _order(a: dict, last: bool = False) -> list[Column]:
    return [field(k).asc_nulls_first() if (v > 0) != last else field(k).desc_nulls_last() for k, v in a.items()]


def _group(df: DataFrame, a: dict, context: dict) -> DataFrame:
    """Accumulators by key.

    ``$first`` and ``$last`` of a value are read from the first and last row of each key in
    the order of the ``$sort`` before.  Each task finds its own first and last rows before
    the shuffle, so one row a task and key is sent, also where the key is null for all rows.
    """
    key = a["_id"]
    order = context.pop("order", None)
    if isinstance(key, dict) and not any(k.startswith("$") for k in key):
        keys = {k: expression(v) for k, v in key.items()}
    else:
        keys = {} if key is None else {"_id": expression(key)}
    ends = {"$first": {}, "$last": {}}
    rest = {}
    for name, spec in a.items():
        if name == "_id":
            continue
        (op, arg), = spec.items()
        (ends[op] if order and op in ends and not isinstance(arg, list) else rest)[name] = arg if order and op in ends and not isinstance(arg, list) else spec
    aggs = [_accumulator(v).alias(k) for k, v in rest.items()]
    named = [c.alias(k) for k, c in keys.items()]
    if not any(ends.values()):
        return (df.groupBy(*named).agg(*aggs) if aggs else df.select(*named).distinct()) if keys else df.agg(*aggs)
    own = {f"__k{i}": c for i, c in enumerate(keys.values())} or {"__k0": F.lit(0)}
    values = {name: arg for at in ends.values() for name, arg in at.items()}
    # Both the keys and what is asked for are computed before the rows are placed.
    held = df.select("*", *[c.alias(k) for k, c in own.items()], *[expression(v).alias(f"__v_{n}") for n, v in values.items()])
    out = None
    for op, asked in ends.items():
        if asked:
            place = F.row_number().over(Window.partitionBy(*own).orderBy(*_order(order, op == "$last")))
            found = held.withColumn(_PLACE, place).where(F.col(_PLACE) == 1).select(*own, *[F.col(f"__v_{n}").alias(n) for n in asked])
            out = found if out is None else _same_keys(out, found, list(own))
    if aggs:
        counted = df.groupBy(*[c.alias(k) for k, c in own.items()]).agg(*aggs)
        out = _same_keys(out, counted, list(own))
    names = list(own) if keys else []
    return out.select(*[F.col(k).alias(n) for k, n in zip(names, keys, strict=True)], *[n for n in a if n != "_id"])


def _same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Two tables of one row a key side by side; null is a key."""
    b = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    return a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]).drop(*[f"{k}_" for k in keys])


def _accumulator(spec: dict) -> Column:
    (op, arg), = spec.items()
    if op == "$push" and arg == "$$ROOT":
        return F.collect_list(expression(arg))
    if op == "$count":
        return F.count(F.lit(1))
    if op in ("$first", "$last"):
        value, by = arg if isinstance(arg, list) else (arg, None)
        if by is None:
            raise PipelineError(f"{op} needs a $sort before, or [value, order]: rows of a table have no order of their own")
        return (F.min_by if op == "$first" else F.max_by)(expression(value), expression(by))
    c = expression(arg)
    found = {"$sum": lambda x: F.coalesce(F.sum(x), F.lit(0)), "$avg": F.avg, "$min": F.min, "$max": F.max, "$push": lambda x: F.array_sort(F.collect_list(x)), "$addToSet": lambda x: F.array_sort(F.collect_set(x))}
    if op not in found:
        raise PipelineError(f"unknown accumulator {op}")
    return found[op](c)


def _unwind(df: DataFrame, a, _) -> DataFrame:
    a = {"path": a} if isinstance(a, str) else a
    name, index = a["path"].lstrip("$"), a.get("includeArrayIndex")
    if not _known(df.schema, name):
        kept = df if a.get("preserveNullAndEmptyArrays") else df.limit(0)
        return kept.withColumns({c: F.lit(None) for c in (name, index) if c})
    made = (F.posexplode_outer if a.get("preserveNullAndEmptyArrays") else F.posexplode)(field(name))
    others = [c for c in df.columns if c != name]
    out = df.select(*others, made.alias(index or "__index", name))
    return out if index else out.drop("__index")


def _sort_by_count(df: DataFrame, a, _) -> DataFrame:
    return df.groupBy(expression(a).alias("_id")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "_id")


def _bucket(df: DataFrame, a: dict, _) -> DataFrame:
    c, bounds = expression(a["groupBy"]), a["boundaries"]
    bucket = F.lit(None)
    for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
        bucket = F.when((c >= low) & (c < high), F.lit(str(low))).otherwise(bucket)
    other = F.lit(str(a["default"])) if "default" in a else F.raise_error(F.lit("$bucket: a value is in no bucket and there is no default")).cast("string")
    out = a.get("output") or {"count": {"$sum": 1}}
    return df.groupBy(F.coalesce(bucket.cast("string"), other).alias("_id")).agg(*[_accumulator(v).alias(k) for k, v in out.items()])


def _bucket_auto(df: DataFrame, a: dict, _) -> DataFrame:
    """Buckets of about equal counts; rows of one value stay together.

    Only the distinct values and their counts are put in order, not the rows.
    """
    n = int(a["buckets"])
    counts = df.groupBy(expression(a["groupBy"]).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    to_here = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("upto", F.sum("n").over(to_here)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    bucket = F.floor((F.col("upto") - F.col("n")) * n / F.col("total")).cast("long")
    placed = placed.withColumn("bucket", bucket)
    bounds = placed.groupBy("bucket").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("n").alias("count"))
    if "output" not in a:
        return bounds
    # Rows find their bucket by its bounds' values, of which there are as many as distinct values.
    rows = df.join(placed.select(F.col("value").alias("__value"), F.col("bucket").alias("__bucket")), expression(a["groupBy"]).eqNullSafe(F.col("__value"))).drop("__value")
    inner = [c for c in rows.columns if c != "__bucket"]
    root = lambda v: F.collect_list(F.struct(*inner)) if v == {"$push": "$$ROOT"} else _accumulator(v)
    out = rows.groupBy(F.col("__bucket").alias("bucket")).agg(*[root(v).alias(k) for k, v in a["output"].items()])
    return bounds.drop("count").join(out, "bucket")


def _redact(df: DataFrame, a: dict, _) -> DataFrame:
    """Keeps or prunes whole rows; a condition that asks to descend is not supported."""

    def truth(e) -> Column:
        if e == "$$KEEP":
            return F.lit(True)
        if e == "$$PRUNE":
            return F.lit(False)
        if isinstance(e, dict) and "$cond" in e:
            c = e["$cond"]
            parts = c if isinstance(c, list) else [c["if"], c["then"], c["else"]]
            return F.when(expression(parts[0]), truth(parts[1])).otherwise(truth(parts[2]))
        raise PipelineError("$redact keeps or prunes rows only")

    return df.where(truth(a))


def _graph_lookup(df: DataFrame, a: dict, context: dict) -> DataFrame:
    depth = min(int(a.get("maxDepth", 0)), MAX_DEPTH)
    edges = context["edges"] if "restrictSearchWithMatch" not in a else context["edges"].where(predicate(a["restrictSearchWithMatch"]))
    direction = "down" if a.get("connectFromField", "target_node_id") == "target_node_id" else "up"
    start = expression(a["startWith"])
    if "as" not in a:
        return graph_lookup(edges, df.select(start.alias("id")), depth, direction)
    reached = graph_lookup_each(edges, df.select(start.alias("id")), depth, direction)
    met = reached.groupBy("root").agg(F.collect_list(F.struct(*edges.columns, F.col("depth").alias(a.get("depthField", "depth")))).alias("__met"))
    empty = F.array().cast(met.schema["__met"].dataType)
    out = df.join(met, start.eqNullSafe(F.col("root")), "left").drop("root")
    return out.withColumn(a["as"], F.coalesce("__met", empty)).drop("__met")


def _vector(df: DataFrame, a: dict, context: dict) -> DataFrame:
    where = predicate(a["filter"]) if a.get("filter") else None
    return vector_search(context.get("vectors", df), a["queryVector"], min(int(a["limit"]), MAX_RESULTS), where, context.get("id", "id"))


STAGES: dict[str, Callable[[DataFrame, object, dict], DataFrame]] = {
    "$vectorSearch": _vector,
    "$match": _match,
    "$project": _project,
    "$sort": _sort,
    "$limit": lambda df, a, _: df.limit(int(a)),
    "$skip": lambda df, a, _: df.offset(int(a)),
    "$count": lambda df, a, _: df.agg(F.count(F.lit(1)).alias(a)).where(F.col(a) > 0),
    "$group": _group,
    "$unwind": _unwind,
    "$graphLookup": _graph_lookup,
    "$addFields": _add_fields,
    "$sample": lambda df, a, _: df.orderBy(F.rand(int(a.get("seed", 0)))).limit(min(int(a["size"]), MAX_RESULTS)),
    "$sortByCount": _sort_by_count,
    "$bucket": _bucket,
    "$bucketAuto": _bucket_auto,
    "$redact": _redact,
}


def validate(stages: list[dict], max_results: int = MAX_RESULTS) -> list[dict]:
    """The stages if each is allowed, with the result limited; the last limit is lowered or one added."""
    if not stages:
        raise PipelineError("a pipeline has at least one stage")
    for i, stage in enumerate(stages):
        if not isinstance(stage, dict) or len(stage) != 1:
            raise PipelineError("a stage is an object with one key")
        (name, _), = stage.items()
        if name not in STAGES:
            raise PipelineError(f"stage {name} is not allowed; allowed are {', '.join(sorted(STAGES))}")
        if name == "$vectorSearch" and i:
            raise PipelineError("$vectorSearch must be the first stage")
    out = [dict(s) for s in stages]
    limits = [i for i, s in enumerate(out) if "$limit" in s]
    if not limits:
        return [*out, {"$limit": max_results}]
    for i in limits:
        out[i] = {"$limit": min(int(out[i]["$limit"]), max_results)}
    return out


def for_tenant(stages: list[dict], user_id: str) -> list[dict]:
    """The stages with the tenant's filter in every place where rows come in; a caller's own is overwritten."""
    if not user_id:
        raise PipelineError("a tenant is needed")
    mine = {"user_id": user_id}
    out = []
    for i, stage in enumerate(stages):
        (name, a), = stage.items()
        if name == "$match" and (i == 0 or "user_id" in a):
            a = {**{k: v for k, v in a.items() if k != "user_id"}, **mine}
        elif name == "$vectorSearch":
            a = {**a, "filter": {**a.get("filter", {}), **mine}}
        elif name == "$graphLookup":
            a = {**a, "restrictSearchWithMatch": {**a.get("restrictSearchWithMatch", {}), **mine}}
        out.append({name: a})
    return out if next(iter(out[0])) in ("$match", "$vectorSearch") else [{"$match": mine}, *out]


def with_embedding(stages: list[dict], embed: Callable[[str], list[float]]) -> list[dict]:
    """The stages with each ``__EMBED__`` replaced by the vector of its ``queryText``."""
    out = []
    for stage in stages:
        a = stage.get("$vectorSearch")
        if a and a.get("queryVector") == "__EMBED__":
            stage = {"$vectorSearch": {**{k: v for k, v in a.items() if k != "queryText"}, "queryVector": embed(a["queryText"])}}
        out.append(stage)
    return out


def run_pipeline(df: DataFrame, stages: list[dict], user_id: str | None = None, max_results: int | None = MAX_RESULTS, **context) -> DataFrame:
    """Apply validated stages in turn.  Fields that no row has are null.  A validated pipeline never returns the column ``embedding``."""
    validated = max_results is not None
    stages = validate(stages, max_results) if max_results is not None else stages
    stages = for_tenant(stages, user_id) if user_id is not None else stages
    for stage in stages:
        (name, a), = stage.items()
        df = STAGES[name](df, _resolved(name, a, df.schema), context)
        # A field that no row has is a text without values.
        df = df.withColumns({c.name: F.lit(None).cast("string") for c in df.schema if isinstance(c.dataType, NullType)})
    return df.drop("embedding") if validated else df


def ask(question: str, translate: Callable[[str, str | None], list[dict]], execute: Callable[[list[dict]], DataFrame], max_retries: int = 2) -> DataFrame:
    """Translate a question and run it; an error in the stages is told to the translator, which may try again."""
    problem = None
    for attempt in range(max_retries + 1):
        try:
            return execute(translate(question, problem))
        except (PySparkException, LookupError, TypeError, ValueError) as e:
            problem = str(e)
            if attempt == max_retries:
                raise
    raise AssertionError
