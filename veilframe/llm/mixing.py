"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / size of the source. Its
whole part is taken outright; the rest is a probability. Probabilities are paired: word mass moves
at random from one document of a pair to the other until one of them is 0 or 1, in such proportions
that neither expectation changes. The other one goes on as the residual. So the words taken by a
pair never change, and a source ends within one small document of its target.

The pairs form a reduction tree: documents of like size meet first, in groups of at most about
``FAN`` rows; each group leaves one residual; groups of residuals follow until each size class of a
source has one. These are decided from the largest down, each against all smaller ones together, so that
the last one left to chance is the smallest.

Everything is DataFrame expressions. Decisions hash the values of the rows, so reruns agree; rows that
repeat each other in all columns are decided one by one, but which of them is which cannot be told.
Groups are dealt out by key, size and text, so rows whose key is null or repeated meet in one only if their texts agree too.
Nulls: a null source is a source of its own, sorted last; a null id is like any other; texts without
words have size 0 and never count. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut, join_small

FAN = 128
#: Size classes for each doubling of the size.
STEPS = 8
_EPS = 1e-9


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII blanks."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """From (source, source_size): adds weight and target. Weights repeat along the sources by code point,
    null last. Targets share the sum of all sizes by weight, none above ``cap`` times its size: what is cut
    off goes to the others by weight, again and again. The fixed point is one level L with target =
    min(cap * size, L * weight), read off the sources in the order in which they reach their caps.
    One row for each source is sorted in one task."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(weights))
    listed = listed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_i") + 1))
    limit = F.col("source_size") * F.lit(float(cap))
    full = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(1))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(0, Window.unboundedFollowing)
    listed = listed.withColumn("_total", F.sum("source_size").over(whole))
    listed = listed.withColumn("_level", (F.col("_total") - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after))
    listed = listed.withColumn("_level", F.min(F.when(F.col("_level") <= limit / F.col("weight") + _EPS, F.struct(limit / F.col("weight"), (-F.col("_level")).alias("less")))).over(whole)["less"])
    # of sources that reach their caps together, the first one's level counts
    return listed.withColumn("target", F.least(limit, F.coalesce(-F.col("_level") * F.col("weight"), limit))).select("source", "source_size", "weight", "target")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _meet(state: Column, x: Column, seed: int) -> Column:
    """state.cur and x meet; the one that becomes integral joins state.done."""
    cur = state["cur"]
    a, b, p, q = cur["size"].cast("double"), x["size"].cast("double"), cur["p"], x["p"]

    def moved(m: Column) -> Column:
        pa = F.when(m["up"], p + m["gain"] / a).otherwise(p - m["loss"] / a)
        qb = F.when(m["up"], q - m["gain"] / b).otherwise(q + m["loss"] / b)
        return F.struct(cur["key"].alias("key"), cur["size"].alias("size"), pa.alias("p"), qb.alias("q"))

    def chances(m: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), cur["key"], x["key"]), F.lit(1 << 40)) / float(1 << 40)
        return F.struct((u * (m["gain"] + m["loss"]) < m["loss"]).alias("up"), m["gain"].alias("gain"), m["loss"].alias("loss"))

    def placed(m: Column) -> Column:
        item = lambda who, prob: F.struct(who["key"].alias("key"), who["size"].alias("size"), prob.alias("p"))
        first = (m["p"] < _EPS) | (m["p"] > 1 - _EPS)
        left, right = item(cur, m["p"]), item(x, m["q"])
        return F.struct(
            F.when(first, right).otherwise(left).alias("cur"),
            F.concat(state["done"], F.array(F.when(first, left).otherwise(right))).alias("done"),
        )

    flow = F.struct(F.least(a * (1 - p), b * q).alias("gain"), F.least(a * p, b * (1 - q)).alias("loss"))
    return _let(_let(_let(flow, chances), moved), placed)


def _round(rows: DataFrame, by: list[str], order: list[Column], seed: int) -> DataFrame:
    """One row for each group: cur, its residual, and done, those decided. rows: by, item (key, size, p)."""
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "item"))).alias("_l"))
    items = F.transform("_l", lambda e: e["item"])
    first = F.struct(F.element_at(items, 1).alias("cur"), F.slice(items, 1, 0).alias("done"))
    state = F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(1))), first, lambda s, x: _meet(s, x, seed))
    return listed.select(*by, state.alias("s")).select(*by, "s.cur", "s.done")


def _settle(rows: DataFrame, seed: int) -> DataFrame:
    """The residuals of each source, one or none for each size class, decided from the largest down. Each meets
    all smaller ones at once: what it takes from them or gives to them to become integral changes their
    probabilities in one proportion, p -> shift + scale * p. Only the last one is left to chance."""
    listed = rows.groupBy("source").agg(F.sort_array(F.collect_list(F.struct((-F.col("item.size")).alias("o"), F.xxhash64(F.lit(seed), "item.key").alias("h"), "item"))).alias("_l"))
    total = lambda f: F.aggregate("_l", F.lit(0.0), lambda t, e: t + f(e["item"]))
    first = F.struct(F.lit(0.0).alias("shift"), F.lit(1.0).alias("scale"), total(lambda x: x["size"].cast("double")).alias("words"), total(lambda x: x["size"] * x["p"]).alias("mass"), F.transform(F.slice("_l", 1, 0), lambda e: e["item"]).alias("done"))

    def step(state: Column, e: Column) -> Column:
        x = e["item"]
        a = x["size"].cast("double")

        def seen(_: Column) -> Column:
            words, mass = state["words"] - a, state["mass"] - a * x["p"]
            p = F.least(F.greatest(state["shift"] + state["scale"] * x["p"], F.lit(0.0)), F.lit(1.0))
            held = F.greatest(state["shift"] * words + state["scale"] * mass, F.lit(0.0))
            return F.struct(words.alias("words"), mass.alias("mass"), p.alias("p"), held.alias("held"), F.greatest(words - held, F.lit(0.0)).alias("room"))

        def flows(v: Column) -> Column:
            u = F.pmod(F.xxhash64(F.lit(seed + 1), x["key"]), F.lit(1 << 40)) / float(1 << 40)
            gain, loss = F.least(a * (1 - v["p"]), v["held"]), F.least(a * v["p"], v["room"])
            return F.struct(v.alias("v"), gain.alias("gain"), loss.alias("loss"), u.alias("u"))

        def moved(m: Column) -> Column:
            v, up = m["v"], m["u"] * (m["gain"] + m["loss"]) < m["loss"]
            p = F.when(up, v["p"] + m["gain"] / a).otherwise(v["p"] - m["loss"] / a)
            keep = F.when(up, F.when(v["held"] > _EPS, 1 - m["gain"] / v["held"]).otherwise(1.0)).otherwise(F.when(v["room"] > _EPS, 1 - m["loss"] / v["room"]).otherwise(1.0))
            return F.struct(v.alias("v"), p.alias("p"), keep.alias("keep"), up.alias("up"), m["u"].alias("u"))

        def placed(m: Column) -> Column:
            chance = F.pmod(F.xxhash64(F.lit(seed + 2), x["key"]), F.lit(1 << 40)) / float(1 << 40)
            p = F.when(m["p"] < _EPS, 0.0).when(m["p"] > 1 - _EPS, 1.0).otherwise((chance < m["p"]).cast("double"))
            # down: 1 - p shrinks, so p -> (1 - keep) + keep * p
            shift = F.when(m["up"], m["keep"] * state["shift"]).otherwise((1 - m["keep"]) + m["keep"] * state["shift"])
            one = F.struct(x["key"].alias("key"), x["size"].alias("size"), p.alias("p"))
            return F.struct(shift.alias("shift"), (m["keep"] * state["scale"]).alias("scale"), m["v"]["words"].alias("words"), m["v"]["mass"].alias("mass"), F.concat(state["done"], F.array(one)).alias("done"))

        return _let(_let(_let(_let(x["p"], seen), flows), moved), placed)

    return listed.select("source", F.aggregate("_l", first, step)["done"].alias("done"))


def mix(docs: DataFrame, key_cols: list[str], weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 3, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: key (a struct of ``key_cols``), source, size, source_size, target, copies."""
    base = cut(docs.select(F.struct(*key_cols).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_h")))
    grade = F.when(F.col("size") > 0, F.floor(F.log2(F.col("size")) * STEPS)).otherwise(-1).cast("int")
    base = base.withColumn("grade", grade)
    counted = cut(base.groupBy("source", "grade").agg(F.sum("size").alias("words"), F.count("*").alias("rows")))
    wanted = targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    wanted = wanted.withColumn("_expected", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    groups = join_small(counted, wanted, ["source"]).select("source", "grade", "source_size", "target", "_expected", F.ceil(F.col("rows") / FAN).alias("_groups"))
    spread = counted.select(F.max("rows").alias("most"), F.count("*").alias("n")).first()
    rows = join_small(base, cut(groups), ["source", "grade"], rows=spread.n)
    whole = F.floor(F.col("_expected") + _EPS)
    rows = rows.withColumn("_whole", whole.cast("long")).withColumn("_p", F.greatest(F.col("_expected") - whole, F.lit(0.0)))
    given = ["source", "size", "source_size", "target"]
    settled = (F.col("size") == 0) | (F.col("_p") < _EPS)
    out = [rows.where(settled).select("key", *given, F.col("_whole").alias("copies"))]
    carried = F.struct("key", *given, "_whole")
    open_rows = rows.where(~settled).select("source", "grade", F.pmod(F.xxhash64(F.lit(seed), "key", "size", "_h"), F.col("_groups")).alias("_g"), F.struct(carried.alias("key"), F.col("size"), F.col("_p").alias("p")).alias("item"))
    decided = lambda item: (item["key"]["key"].alias("key"), *[item["key"][c].alias(c) for c in given], (item["key"]["_whole"] + (item["p"] > 0.5).cast("long")).alias("copies"))

    groups_left, level = -(-(spread.most or 0) // FAN), 0
    by = ["source", "grade", "_g"]
    while True:
        order = [F.xxhash64(F.lit(seed + level), F.col("item.key"))]
        done = cut(_round(open_rows, by, order, seed * 1000 + level))
        out.append(done.select(F.explode("done").alias("d")).select(*decided(F.col("d"))))
        level += 1
        if groups_left <= 1:
            break
        groups_left = -(-groups_left // FAN)
        open_rows = done.select("source", "grade", F.floor(F.col("_g") / FAN).alias("_g"), F.col("cur").alias("item"))
    last = _settle(done.select("source", F.col("cur").alias("item")), seed * 1000 + level)
    out.append(last.select(F.explode("done").alias("d")).select(*decided(F.col("d"))))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: every row of docs as many times as it is taken, with ``copy_no`` from 1."""
    names = [c for c in docs.columns if c != "copy_no"]
    parts = [part for c in (id_col, source_col, text_col) for part in (F.when(F.col(c).isNull(), "-").otherwise("+"), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    key = F.md5(F.concat_ws("\x00", *parts).cast("binary"))
    tie = F.xxhash64(*[c for c in names if "map<" not in docs.schema[c].dataType.simpleString()])
    # the row travels as a whole, so that no name of its own can clash
    keyed = docs.select(key.alias("k"), tie.alias("tie"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.struct(*names).alias("row"))
    taken = mix(keyed, ["k"], text_col="text", source_col="source", **options)
    # rows alike in id, source and text share a key: the n-th of them, by all columns, gets the n-th decision
    lists = taken.groupBy(F.col("key.k").alias("k")).agg(F.sort_array(F.collect_list("copies")).alias("copies")).where(F.array_max("copies") > 0)
    nth = F.row_number().over(Window.partitionBy("k").orderBy("tie"))
    joined = keyed.select("k", "tie", "row").join(lists, "k").withColumn("n", nth).select("row", F.element_at("copies", F.col("n")).alias("c"))
    return joined.where("c > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("copy_no"))
