"""Change-log synthesis: a base table becomes numbered steps of creates, updates and deletes.

No key set lives on the driver: what happens to a key follows from hashes of the key, so every row decides for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored
from .relational import Tables
from .scans import numbered

c = F.col
#: Creates come before updates and updates before deletes within a step.
RANK = {"c": 0, "u": 1, "d": 2}
#: Rows of the standard tables at scale 1; the first two have the same size at any scale. Fixed values.
ROWS_AT_ONE = {"region": 5, "nation": 25, "supplier": 10_000, "customer": 150_000, "part": 200_000, "partsupp": 800_000, "orders": 1_500_000, "lineitem": 6_001_215}
FIXED = ("region", "nation")


def sequence_table(spark: SparkSession, n: int) -> DataFrame:
    """id and value = 10 * id."""
    return spark.range(n).select("id", (c("id") * 10).alias("value"))


#: Draws lie in [0, DRAWS).
DRAWS = 1 << 62
#: Draws are counted in so many buckets at a time; of a bucket of so few keys the one sought is fetched.
BINS, FEW = 4096, 1000


def hashed(seed: int) -> Callable[..., Column]:
    """A draw in [0, DRAWS) from the key, the step and what is drawn."""
    return lambda keys, step, what: F.xxhash64(*keys, step, F.lit(what), F.lit(seed)).bitwiseAND(F.lit(DRAWS - 1))


def birth_steps(base: DataFrame, keys: list[str], steps: int, draw: Callable[..., Column], dimension: bool = False) -> DataFrame:
    """base plus step, the one in which a row is created; a dimension comes whole in step 0."""
    step = F.lit(0) if dimension else draw([c(k) for k in keys], F.lit(-1), "birth") % steps
    return base.withColumn("step", step.cast("int"))


def jittered(n: int, step: int, what: int, seed: int) -> int:
    """A count from three quarters to five quarters of n, both included."""
    lo, hi = n * 3 // 4, -(-n * 5 // 4)
    return lo + (step * 7919 + what * 104_729 + seed * 31) % (hi - lo + 1)


def capped(updates: int, deletes: int, live: int) -> tuple[int, int]:
    """Both counts, scaled down together if they exceed the live keys."""
    total = updates + deletes
    return (updates * live // total, deletes * live // total) if total > live else (updates, deletes)


def least(rows: DataFrame, keys: list[str], ranks: list[int], span: int = DRAWS) -> list[tuple | None]:
    """The (draw, *keys) of the row of each rank (from 1) by draw and key; None for rank 0.

    rows has draw, a number in [0, span), and keys that tell its rows apart. Draws are counted in buckets, and the bucket that holds a
    rank is counted again in finer ones, until it has FEW rows; those are fetched, or numbered across ranges if they all have one
    draw. So BINS counts for each rank, or FEW rows, are all that reaches the driver.
    """
    at = {r: (0, span, r, None) for r in ranks if r > 0}  # bucket's start and width, rank in it, rows in it
    open_ = lambda x: x[1] > 1 and (x[3] is None or x[3] > FEW)
    while any(map(open_, at.values())):
        windows = sorted({x[:2] for x in at.values() if open_(x)})
        which = F.lit(None)
        for i, (lo, width) in enumerate(windows):
            finer = -(-width // BINS)
            which = F.when((c("draw") >= lo) & (c("draw") < lo + width), F.struct(F.lit(i).alias("w"), F.floor((c("draw") - lo) / finer).alias("b") if finer < 1 << 40 else F.expr(f"(draw - {lo}) div {finer}").alias("b"))).otherwise(which)
        counts: dict[int, list] = {}
        for r in rows.groupBy(which.alias("x")).count().where("x is not null").collect():  # BINS rows for each window
            counts.setdefault(r.x.w, []).append((r.x.b, r["count"]))
        for rank, (lo, width, k, n) in at.items():
            if not open_((lo, width, k, n)):
                continue
            finer = -(-width // BINS)
            for b, n in sorted(counts[windows.index((lo, width))]):
                if k <= n:
                    at[rank] = (lo + b * finer, finer, k, n)
                    break
                k -= n
    out = {}
    for rank, (lo, width, k, n) in at.items():
        own = rows.where((c("draw") >= lo) & (c("draw") < lo + width)).select("draw", *keys)
        if n is None or n > FEW:
            out[rank] = tuple(numbered(own, ["draw", *keys]).where(c("position") == k - 1).select("draw", *keys).first())
        else:
            out[rank] = tuple(own.orderBy("draw", *keys).limit(k).collect()[-1])  # FEW rows at most
    return [out.get(r) for r in ranks]


def mutation_plan(born: DataFrame, keys: list[str], wanted: dict[int, Callable[[int], tuple[int, int]]], draw: Callable[..., Column], span: int = DRAWS) -> dict[int, tuple]:
    """For each step of wanted, the last (draw, *keys) that is updated and the last that is deleted; None where nothing is.

    wanted[step] gives both counts for a number of live keys, which `capped` bounds. Of the keys alive in a step (born by then and deleted in no step before) those
    with the least draws are updated, as many as asked exactly, and the next are deleted. A key and its step of birth is all that is
    read; what is alive follows from the limits of the steps before, so only counts and limits are on the driver.
    """
    rows = stored(born.select(*keys, "step"), "born")
    births = {r.step: r["count"] for r in rows.groupBy("step").count().collect()}  # one row per step
    plan: dict[int, tuple] = {}
    gone = 0
    for s in sorted(wanted):
        live = sum(n for b, n in births.items() if b <= s) - gone
        u, d = capped(*wanted[s](live), live)
        if u + d:
            alive = rows.where((c("step") <= s) & _deleted_at(keys, plan, draw).isNull()).withColumn("draw", draw([c(k) for k in keys], F.lit(s), "drawn"))
            plan[s] = tuple(least(alive, keys, [u, u + d], span))
            gone += d
    return plan


def _upto(keys: list[str], step: int, limit: tuple | None, draw: Callable[..., Column]) -> Column:
    """Whether a key's draw in a step, and of equal draws the key, is at most the limit."""
    if limit is None:
        return F.lit(False)
    own = F.struct(draw([c(k) for k in keys], F.lit(step), "drawn").cast("long").alias("d"), *keys)
    return own <= F.struct(F.lit(limit[0]).cast("long").alias("d"), *(F.lit(v).alias(k) for k, v in zip(keys, limit[1:], strict=True)))


def _deleted_at(keys: list[str], plan: dict[int, tuple], draw: Callable[..., Column]) -> Column:
    """The step in which a row (keys, step of birth) is deleted: the first in which its draw lies between the limits."""
    out = F.lit(None).cast("int")
    for s in sorted(plan, reverse=True):
        updated, deleted = plan[s]
        if deleted != updated:
            out = F.when((c("step") <= s) & _upto(keys, s, deleted, draw) & ~_upto(keys, s, updated, draw), s).otherwise(out)
    return out


def mutations(born: DataFrame, keys: list[str], plan: dict[int, tuple], draw: Callable[..., Column]) -> DataFrame:
    """(keys, step, _op): each key's updates and its one delete, after which nothing happens to it."""
    none = F.lit(None).cast("int")
    marked = born.select(*keys, "step", _deleted_at(keys, plan, draw).alias("__d"))
    hit = [F.when((c("step") <= s) & (c("__d").isNull() | (c("__d") > s)) & _upto(keys, s, u, draw), s).otherwise(none) for s, (u, _) in sorted(plan.items())]
    drawn = marked.withColumn("__u", F.array_compact(F.array(*hit)) if hit else F.array().cast("array<int>"))
    updates = drawn.select(*keys, F.explode("__u").alias("step"), F.lit("u").alias("_op"))
    return updates.unionByName(drawn.where(c("__d").isNotNull()).select(*keys, c("__d").alias("step"), F.lit("d").alias("_op")))


def hashed_values(seed: int) -> Callable[..., Column]:
    """A number for a value, from the key, the step and the column's name."""
    return lambda keys, step, name: F.xxhash64(*keys, step, F.lit(name), F.lit(seed))


def random_payload(rows: DataFrame, keys: list[str], value: Callable[..., Column]) -> DataFrame:
    """Every non-key column replaced by a typed value that follows from value(keys, step, column name)."""
    out = rows
    for f in rows.schema.fields:
        if f.name in (*keys, "step", "_op", "_op_index"):
            continue
        h = value([c(k) for k in keys], c("step"), f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType)):
            v = F.pmod(h, F.lit(99)) + 1
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            v = F.pmod(h, F.lit(999_999 if isinstance(f.dataType, T.IntegerType) else 999_999_999)) + 1
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            v = F.pmod(h, F.lit(10_000_000)) / 10_000
        elif isinstance(f.dataType, T.DateType):
            v = F.date_add(F.lit("1970-01-01").cast("date"), (F.pmod(h, F.lit(12_000)) + 8_000).cast("int"))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            v = F.timestamp_seconds((F.pmod(h, F.lit(12_000)) + 8_000) * 86_400)
        elif isinstance(f.dataType, T.BooleanType):
            v = F.pmod(h, F.lit(2)) == 0
        else:
            v = F.substring(F.sha2(h.cast("string").cast("binary"), 256), 1, 10)
        out = out.withColumn(f.name, v.cast(f.dataType))
    return out


def tagged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows plus _op_index, gapless from 0 by step, operation (creates, updates, deletes) and key.

    Rows are numbered in the stored ranges of a sort, so the index is the same at every read.
    """
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[c("_op")]
    return numbered(rows.withColumn("__rank", rank), ["step", "__rank", *keys]).drop("__rank").withColumnRenamed("position", "_op_index")


def synthesize(base: DataFrame, keys: list[str], steps: int = 20, update_ratio: float = 0.1, delete_ratio: float = 0.05, seed: int = 7, bootstrap: bool = False, mutation_steps: int = 5, churn: float = 0.1, dimension: bool = False, draw: Callable[..., Column] | None = None, value: Callable[..., Column] | None = None, span: int = DRAWS) -> DataFrame:
    """The change log of base: its columns, batch_id, _op and _op_index. Delete rows hold the key and nulls.

    Each step updates round(update_ratio * creates) and deletes round(delete_ratio * creates) distinct live keys, give or take a
    quarter, exactly so many, or fewer in proportion where they exceed the live keys. bootstrap: all rows are created in step 0; then each
    of mutation_steps steps changes round(live keys * churn / mutation_steps), with no jitter, updates and deletes in the
    proportion of their ratios. A dimension is created whole and never changed. draw (in [0, span)) and value take the place of hashes
    where something else must repeat them.
    """
    draw = draw or hashed(seed)
    born = birth_steps(base, keys, steps, draw, dimension or bootstrap)
    if dimension:
        wanted = {}
    elif bootstrap:
        total = update_ratio + delete_ratio
        weight = update_ratio / total if total > 0 else 1.0

        def churned(live: int) -> tuple[int, int]:
            each = round(live * churn / max(mutation_steps, 1))
            return round(each * weight), each - round(each * weight)

        wanted = {s: churned for s in range(1, 1 + mutation_steps)}
    else:
        creates = {r[0]: r[1] for r in born.groupBy("step").count().collect()}  # one row per step
        wanted = {s: (lambda live, s=s: tuple(jittered(round(creates.get(s, 0) * r), s, w, seed) for w, r in ((1, update_ratio), (2, delete_ratio)))) for s in range(steps)}
    changes = mutations(born, keys, mutation_plan(born, keys, wanted, draw, span), draw)
    payload = [f for f in base.columns if f not in keys]
    empty = lambda rows: rows.select(*keys, *(F.lit(None).cast(base.schema[p].dataType).alias(p) for p in payload), "step", "_op")
    updates = random_payload(empty(changes.where("_op = 'u'")), keys, value or hashed_values(seed))
    deletes = empty(changes.where("_op = 'd'"))
    log = born.withColumn("_op", F.lit("c")).unionByName(updates.select(*base.columns, "step", "_op")).unionByName(deletes)
    return tagged(log, keys).withColumnRenamed("step", "batch_id")


def live_keys(log: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Keys alive after a step: those whose last operation isn't a delete."""
    return log.where(c("batch_id") <= step).groupBy(*keys).agg(F.max_by("_op", "_op_index").alias("last")).where("last <> 'd'").select(*keys)


def generation_counts(log: DataFrame, name: str) -> DataFrame:
    return log.groupBy(F.lit(name).alias("table_name"), "batch_id").pivot("_op", ["c", "u", "d"]).agg(F.count("_op_index")).na.fill(0)


def log_kind(log: DataFrame) -> DataFrame:
    """`events` for a log of creates only, else `changes`."""
    return log.agg(F.when(F.bool_or(c("_op") != "c"), "changes").otherwise("events").alias("kind"))


def expected_rows(spark: SparkSession, scale: float) -> DataFrame:
    return spark.createDataFrame([(n, k if n in FIXED else round(k * scale)) for n, k in ROWS_AT_ONE.items()], "table_name string, expected long")


# A log of orders by integer arithmetic, so that SQL can compute it too.
ORDERS_LOG = """orders_log AS (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderkey % 5 AS BIGINT) AS batch_id, 'c' AS _op, (o_orderkey % 5) * 1000000000 + o_orderkey AS _op_index FROM orders
  UNION ALL
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey + 1 END, 'U', o_totalprice + s, o_orderkey % 5 + s, 'u', (o_orderkey % 5 + s) * 1000000000 + 100000000 + o_orderkey
  FROM orders CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 4) AS steps WHERE (o_orderkey * 7 + s * 3) % 10 < 3
  UNION ALL
  SELECT o_orderkey, NULL, NULL, NULL, o_orderkey % 5 + 3, 'd', (o_orderkey % 5 + 3) * 1000000000 + 200000000 + o_orderkey FROM orders WHERE o_orderkey % 11 = 0)"""


def orders_log(t: Tables) -> DataFrame:
    """The log above: creates in 5 steps, updates 1, 2 or 4 steps later, some after the delete 3 steps later (and so of no effect)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    step, key = c("o_orderkey") % 5, c("o_orderkey")
    made = o.select("*", step.alias("batch_id"), F.lit("c").alias("_op"), (step * 1_000_000_000 + key).alias("_op_index"))
    s = c("s").cast("long")
    changed = o.withColumn("s", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4)))).where((key * 7 + s * 3) % 10 < 3).select(
        "o_orderkey", F.when(key % 4 != 0, c("o_custkey") + 1).alias("o_custkey"), F.lit("U").alias("o_orderstatus"), (c("o_totalprice") + s).alias("o_totalprice"),
        (step + s).alias("batch_id"), F.lit("u").alias("_op"), ((step + s) * 1_000_000_000 + 100_000_000 + key).alias("_op_index"))
    none = lambda n: F.lit(None).cast(o.schema[n].dataType).alias(n)
    gone = o.where(key % 11 == 0).select("o_orderkey", none("o_custkey"), none("o_orderstatus"), none("o_totalprice"), (step + 3).alias("batch_id"), F.lit("d").alias("_op"), ((step + 3) * 1_000_000_000 + 200_000_000 + key).alias("_op_index"))
    return made.unionByName(changed).unionByName(gone)


def by_arithmetic(keys, step, what):
    """A draw that integer SQL repeats."""
    return F.pmod(keys[0] * 7919 + step.cast("long") * 40_503 + {"birth": 1, "drawn": 2}[what] * 104_729, F.lit(1_000_000).cast("long"))


def values_by_arithmetic(keys, step, name):
    return keys[0] * 7919 + step.cast("long") * 40_503 + len(name) * 104_729


def _sampled_sql(born: str, first: int, steps: int, wanted: str) -> str:
    """The recursion drawn: every key at every step it lives to see (s, birth), and what happens to it (op).

    born: (c_custkey, birth); wanted: a query of w(s, wu, wd) counts over live(s, live).
    """
    return f"""born AS ({born}),
drawn AS (
  SELECT c_custkey, birth, {first - 1} AS s, CAST(NULL AS VARCHAR) AS op FROM born
  UNION ALL
  SELECT c_custkey, birth, s, CASE WHEN birth > s THEN NULL WHEN place <= u THEN 'u' WHEN place <= u + d THEN 'd' END
  FROM (SELECT *, CASE WHEN wu + wd > live THEN wu * live // (wu + wd) ELSE wu END AS u, CASE WHEN wu + wd > live THEN wd * live // (wu + wd) ELSE wd END AS d
    FROM (SELECT *, {wanted}
      FROM (SELECT c_custkey, birth, s + 1 AS s, count(*) FILTER (birth <= s + 1) OVER () AS live, count(*) FILTER (birth = s + 1) OVER () AS creates,
          row_number() OVER (PARTITION BY birth <= s + 1 ORDER BY (c_custkey * 7919 + (s + 1) * 40503 + 209458) % 1000000, c_custkey) AS place
        FROM drawn WHERE op IS DISTINCT FROM 'd' AND s < {first + steps - 1}))))"""


def _bootstrap_sql(churn: float, steps: int) -> str:
    """The log of synthesize(customer, bootstrap, both by arithmetic): counts wanted, capped by the live keys, then drawn."""
    h = lambda name: f"(c_custkey * 7919 + s * 40503 + {len(name) * 104_729})"
    text = lambda name: f"substring(sha256(CAST({h(name)} AS VARCHAR)), 1, 10)"
    each = f"CAST(round_even(live * {churn}::DOUBLE / {steps}, 0) AS BIGINT)"
    wanted = f"CAST(round_even({each} * (0.1::DOUBLE / (0.1::DOUBLE + 0.05::DOUBLE)), 0) AS BIGINT) AS wu, {each} - wu AS wd"
    return f"""WITH RECURSIVE {_sampled_sql("SELECT c_custkey, 0 AS birth FROM customer", 1, steps, wanted)}
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, CAST(0 AS INT) AS batch_id, 'c' AS _op FROM customer
UNION ALL SELECT c_custkey, {text('c_name')}, CAST({h('c_nationkey')} % 999999 + 1 AS INT), {h('c_acctbal')} % 10000000 / 10000::DOUBLE, {text('c_mktsegment')}, CAST(s AS INT), 'u' FROM drawn WHERE op = 'u'
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, CAST(s AS INT), 'd' FROM drawn WHERE op = 'd'"""


def _bootstrapped(t: Tables, churn: float, steps: int) -> DataFrame:
    return synthesize(t.customer, ["c_custkey"], bootstrap=True, mutation_steps=steps, churn=churn, draw=by_arithmetic, value=values_by_arithmetic, span=1_000_000).drop("_op_index")


_BORN = "born AS (SELECT c_custkey, CAST(((c_custkey * 7919 - 40503 + 104729) % 1000000) % 6 AS INT) AS step FROM customer)"
#: Updates of half and deletes of a fifth of the creates, give or take a quarter, in each of six steps.
_RATIOS, _STEPS, _SEED = (0.5, 0.2), 6, 7


def _jittered_sql(ratio: float, what: int) -> str:
    n = f"CAST(round_even(creates * {ratio}::DOUBLE, 0) AS BIGINT)"
    return f"{n} * 3 // 4 + (s * 7919 + {what * 104_729 + _SEED * 31}) % (({n} * 5 + 3) // 4 - {n} * 3 // 4 + 1)"


def _mutations_sql() -> str:
    wanted = f"{_jittered_sql(_RATIOS[0], 1)} AS wu, {_jittered_sql(_RATIOS[1], 2)} AS wd"
    born = f"SELECT c_custkey, CAST(((c_custkey * 7919 - 40503 + 104729) % 1000000) % {_STEPS} AS INT) AS birth FROM customer"
    return f"WITH RECURSIVE {_sampled_sql(born, 0, _STEPS, wanted)} SELECT c_custkey, CAST(s AS INT) AS step, op AS _op FROM drawn WHERE op IS NOT NULL"


def _mutations(t: Tables) -> DataFrame:
    log = synthesize(t.customer.select("c_custkey"), ["c_custkey"], _STEPS, *_RATIOS, seed=_SEED, draw=by_arithmetic, value=values_by_arithmetic, span=1_000_000)
    return log.where("_op <> 'c'").select("c_custkey", c("batch_id").alias("step"), "_op")


def _scaled(t: Tables) -> DataFrame:
    """Actual and expected rows of every standard table that the folder holds, at the scale that its orders show; partsupp is derived from the lines."""
    names = [n for n in ROWS_AT_ONE if n != "partsupp"]
    actual = reduce(DataFrame.unionByName, (getattr(t, n).agg(F.count("*").alias("actual")).select(F.lit(n).alias("table_name"), "actual") for n in names))
    pairs = t.lineitem.select("l_partkey", "l_suppkey").distinct().agg(F.count("*").alias("actual")).select(F.lit("partsupp").alias("table_name"), "actual")
    return actual.unionByName(pairs).join(expected_rows(t.spark, t.orders.count() / ROWS_AT_ONE["orders"]), "table_name")


def _scaled_sql() -> str:
    rows = lambda n: "(SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem))" if n == "partsupp" else f"(SELECT count(*) FROM {n})"
    scale = f"((SELECT count(*) FROM orders) / {ROWS_AT_ONE['orders']}::DOUBLE)"
    return " UNION ALL ".join(f"SELECT '{n}' AS table_name, {rows(n)} AS actual, CAST({k if n in FIXED else f'round_even({k} * {scale}, 0)'} AS BIGINT) AS expected" for n, k in ROWS_AT_ONE.items())


def _tagged(t: Tables) -> DataFrame:
    """The orders log numbered anew: each row's place, and whether two reads agree on it."""
    log = tagged(orders_log(t).drop("_op_index").withColumnRenamed("batch_id", "step"), ["o_orderkey"])
    row = ["o_orderkey", "step", "_op", "o_totalprice"]
    return log.select(*row, "_op_index").intersect(log.repartition("o_orderkey").select(*row, "_op_index"))


def _sequenced(t: Tables) -> DataFrame:
    """Every customer's key in a sequence as long as the table's keys need."""
    keys = t.customer.select("c_custkey")
    last = keys.agg(F.max("c_custkey")).first()[0]
    return keys.join(sequence_table(t.spark, 0 if last is None else last + 1), c("c_custkey") == c("id")).select("id", "value")


ALL = {
    "g1_sequence_whole": (_sequenced, "SELECT c_custkey AS id, c_custkey * 10 AS value FROM customer"),
    "g2_step_partitioning": (lambda t: birth_steps(t.customer.select("c_custkey"), ["c_custkey"], 6, by_arithmetic), f"WITH {_BORN} SELECT c_custkey, step FROM born"),
    "g3_operation_tagging": (_tagged, f"WITH {ORDERS_LOG} SELECT o_orderkey, batch_id AS step, _op, o_totalprice, row_number() OVER (ORDER BY batch_id, CASE _op WHEN 'c' THEN 0 WHEN 'u' THEN 1 ELSE 2 END, o_orderkey) - 1 AS _op_index FROM orders_log"),
    "g4_update_and_g5_delete_sampling": (_mutations, _mutations_sql()),
    "g9_live_keys": (lambda t: live_keys(orders_log(t), ["o_orderkey"], 5), f"WITH {ORDERS_LOG} SELECT o_orderkey FROM orders_log WHERE batch_id <= 5 GROUP BY o_orderkey HAVING arg_max(_op, _op_index) <> 'd'"),
    "g10_generation_counts": (lambda t: generation_counts(orders_log(t), "orders"), f"WITH {ORDERS_LOG} SELECT 'orders' AS table_name, batch_id, count(*) FILTER (_op = 'c') AS c, count(*) FILTER (_op = 'u') AS u, count(*) FILTER (_op = 'd') AS d FROM orders_log GROUP BY batch_id"),
    "g11_log_kind": (lambda t: log_kind(orders_log(t)).unionByName(log_kind(orders_log(t).where("batch_id = 0"))), f"WITH {ORDERS_LOG} SELECT CASE WHEN bool_or(_op <> 'c') THEN 'changes' ELSE 'events' END AS kind FROM orders_log UNION ALL SELECT CASE WHEN bool_or(_op <> 'c') THEN 'changes' ELSE 'events' END FROM orders_log WHERE batch_id = 0"),
    "g12_expected_rows": (_scaled, _scaled_sql()),
    "g6_capped_counts": (lambda t: _bootstrapped(t, 6.0, 4), _bootstrap_sql(6.0, 4)),
    "g7_g8_bootstrap_by_arithmetic": (lambda t: _bootstrapped(t, 0.4, 4), _bootstrap_sql(0.4, 4)),
    "g7_bootstrap_log": (lambda t: synthesize(t.customer, ["c_custkey"], bootstrap=True, mutation_steps=4, churn=0.2), None),
    "g8_random_payload_log": (lambda t: synthesize(t.supplier, ["s_suppkey"], steps=5, update_ratio=0.4, delete_ratio=0.1), None),
}


def _spaced(t: Tables) -> DataFrame:
    """Orders per place of a sequence: a row for each tenth key, and the orders of the ten keys from it on."""
    tenth = (c("o_orderkey") - c("o_orderkey") % 10).alias("value")
    n = t.orders.groupBy(tenth).agg(F.count("*").alias("n"))
    last = t.orders.agg(F.max("o_orderkey")).first()[0]
    return sequence_table(t.spark, 0 if last is None else last // 10 + 1).join(n, "value", "left").select("id", "value", F.coalesce("n", F.lit(0)).alias("n"))


ALL["g1_sequence_table"] = (_spaced, "SELECT s.id, s.id * 10 AS value, count(o_orderkey) AS n FROM (SELECT unnest(range(0, (SELECT max(o_orderkey) // 10 + 1 FROM orders))) AS id) s LEFT JOIN orders ON o_orderkey // 10 = s.id GROUP BY s.id")


def queries() -> dict:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
