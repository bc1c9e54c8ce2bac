"""Entity index and document relations: keyed hashes, pair scores, clusters, routing of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import MEDIUM, STRONG, weight
from ..functions.text import hmac_sha256, index_tokens, index_value
from .graph import connected_components
from .lineage import cut, join_counted, join_small

#: Types whose tokens are indexed one by one as well.
TOKENISED = ("LOCATION", "ORGANIZATION_NAME", "POSTAL_ADDRESS")


def hashes(entity_type: Column, value: Column, key: bytes) -> Column:
    """Keyed hashes of the value and, for some types, of its tokens; none for a value of punctuation only."""
    whole = index_value(value)
    tokens = F.when(entity_type.isin(*TOKENISED), F.filter(index_tokens(whole), lambda t: t != whole)).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.array(whole), tokens))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.transform(every, lambda v: hmac_sha256(v, key)))


def build(entities: DataFrame, key: bytes, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_type, value_hash, occurrences)."""
    exploded = entities.select(id_col, "entity_type", F.explode(hashes(F.col("entity_type"), F.col("value"), key)).alias("value_hash"))
    return exploded.groupBy(id_col, "entity_type", "value_hash").agg(F.count("*").alias("occurrences"))


def score_documents(index: DataFrame, asked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, score): weights of the asked entities that a document shares. asked: (signature, entity_type, value_hash), rows
    of one signature being one entity; entities with the same type and hashes count once."""
    named = asked.groupBy("signature", "entity_type").agg(F.array_join(F.array_sort(F.collect_set("value_hash")), "").alias("all"))
    once = named.groupBy("entity_type", "all").agg(F.min("signature").alias("signature"))
    rows = asked.join(once.select("signature", "entity_type"), ["signature", "entity_type"], "left_semi").select("signature", "entity_type", "value_hash").distinct()
    hit = join_small(index, rows, ["entity_type", "value_hash"]).select(id_col, "signature", "entity_type").distinct()
    return hit.groupBy(id_col).agg(F.round(F.sum(weight(F.col("entity_type"))), 6).alias("score"))


def _met(index: DataFrame, id_col: str) -> DataFrame:
    """(doc_a, doc_b, entity_type, value_hash) of documents that share a value. A value held by n documents makes
    n * (n - 1) / 2 rows by definition; rows of one value are dealt out by salts on one side, so no task holds them all."""
    keyed = index.select(F.col(id_col).alias("d"), "entity_type", "value_hash").distinct()
    shared = keyed.groupBy("entity_type", "value_hash").agg(F.count("*").alias("n")).where("n > 1")
    kept = keyed.join(shared, ["entity_type", "value_hash"])
    salts = F.ceil(F.col("n") / 1000).cast("int")
    left = kept.withColumn("s", F.pmod(F.xxhash64("d"), salts.cast("long"))).select("entity_type", "value_hash", "s", F.col("d").alias("doc_a"))
    right = kept.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1))).select("entity_type", "value_hash", "s", F.col("d").alias("doc_b"))
    return left.join(right, ["entity_type", "value_hash", "s"]).where("doc_a < doc_b").drop("s")


def pairs(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b, score, shared_entity_count) of documents that share entities."""
    score = F.round(F.sum(weight(F.col("entity_type"))), 6).alias("score")
    return _met(index, id_col).groupBy("doc_a", "doc_b").agg(score, F.count("*").alias("shared_entity_count"))


def touched(index: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b, units, n): the pairs with at least one document among ids, weights in millionths. Only values of those documents are
    looked at; one
    held by many documents is dealt out by salts."""
    keyed = index.select(F.col(id_col).alias("d"), "entity_type", "value_hash").distinct()
    mine = cut(keyed.join(ids.select(F.col(id_col).alias("d")).distinct(), "d", "left_semi").withColumnRenamed("d", "m"))
    values = mine.groupBy("entity_type", "value_hash").agg(F.count("*").alias("n"))
    held = keyed.join(values, ["entity_type", "value_hash"])
    salts = F.ceil(F.col("n") / 1000).cast("long")
    right = mine.join(values, ["entity_type", "value_hash"]).withColumn("s", F.pmod(F.xxhash64("m"), salts)).drop("n")
    left = held.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("n")
    met = left.join(right, ["entity_type", "value_hash", "s"]).where("d <> m")
    # a pair with both documents among ids is met twice
    once = met.select(F.least("d", "m").alias("doc_a"), F.greatest("d", "m").alias("doc_b"), "entity_type", "value_hash").distinct()
    return once.groupBy("doc_a", "doc_b").agg(F.sum(F.round(weight(F.col("entity_type")) * _UNIT).cast("long")).alias("units"), F.count("*").alias("n"))


def maintain(relations: DataFrame, index: DataFrame, fresh: DataFrame, id_col: str = "doc_id", ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(relations, index) after all rows of some documents (those of ``fresh``, or ``ids``) are replaced by ``fresh``, relations being
    those of ``pairs``: what the documents had
    added to any pair is taken away, what they add now is put in. Equal to a rebuild, at the cost of the values that these documents hold or held."""
    ids = (fresh if ids is None else ids).select(id_col).distinct()
    after = index.join(ids, id_col, "left_anti").unionByName(fresh)
    sign = lambda df, by: df.select("doc_a", "doc_b", (F.col("units") * by).alias("units"), (F.col("n") * by).alias("n"))
    stored = relations.select("doc_a", "doc_b", F.round(F.col("score") * _UNIT).cast("long").alias("units"), F.col("shared_entity_count").alias("n"))
    deltas = sign(touched(index, ids, id_col), -1).unionByName(sign(touched(after, ids, id_col), 1))
    summed = stored.unionByName(deltas).groupBy("doc_a", "doc_b").agg(F.sum("units").alias("units"), F.sum("n").alias("n")).where("n > 0")
    return summed.select("doc_a", "doc_b", F.round(F.col("units") / _UNIT, 6).alias("score"), F.col("n").alias("shared_entity_count")), after


def shared_types(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_a, doc_b, entity_type, n): the pairs by type."""
    return _met(index, id_col).groupBy("doc_a", "doc_b", "entity_type").agg(F.count("*").alias("n"))


def clusters(edges: DataFrame, least: float = MEDIUM) -> DataFrame:
    """(doc_id, cluster): components of the pairs with at least ``least``, named by the smallest document."""
    found = connected_components(edges.where(F.col("score") >= least), "doc_a", "doc_b")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


#: Holders of a set of values up to which they are compared with each other.
FEW_HOLDERS = 64
_UNIT = 1_000_000


def cluster_documents(index: DataFrame, id_col: str = "doc_id", least: float = MEDIUM, of_type=weight) -> DataFrame:
    """(doc_id, cluster): components of the documents that share values of at least ``least`` in sum, named by the smallest document, without
    listing pairs. Documents with one of their sums are drawn as a star around the set of values that reaches it:

    * a value that weighs enough by itself links its holders: one row for each;
    * documents with the same light values, if these weigh enough together, are one document from here on;
    * else sets of light values are grown, rarest first, as long as what may still come can reach ``least``. Holders of a set that
      weighs enough are linked, sets of one holder end, and sets of at most FEW_HOLDERS have their holders compared.

    So a value held by every document adds a row for each, and each set that is grown further has more holders than are worth comparing."""
    goal = round(least * _UNIT)
    key = F.concat_ws(":", "entity_type", "value_hash")
    keyed = index.select(F.col(id_col).alias("d"), key.alias("v"), F.round(of_type(F.col("entity_type")) * _UNIT).cast("long").alias("w")).distinct()
    shared = keyed.groupBy("v").agg(F.count("*").alias("n"), F.min("d").alias("hub")).where("n > 1")
    kept = cut(join_counted(cut(keyed), cut(shared), "v"))
    links = [kept.where(F.col("w") >= goal).select("hub", "d")]
    light = kept.where(F.col("w") < goal)
    # documents alike in all their light values: one stands for all
    alike = light.groupBy("d").agg(F.sum("w").alias("all"), F.count("*").alias("m"), F.bit_xor(F.xxhash64(F.lit(1), "v")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(2), "v")).alias("h2"))
    alike = cut(alike.where(F.col("all") >= goal))
    first = alike.groupBy("all", "m", "h1", "h2").agg(F.min("d").alias("hub"), F.count("*").alias("n"))
    same = F.struct("all", "m", "h1", "h2")
    links.append(join_counted(alike.select(same.alias("s"), "d"), cut(first.select(same.alias("s"), "hub", "n").where("n > 1")), "s").select("hub", "d"))
    one = cut(light.join(cut(first.select(F.col("hub").alias("d"))), "d", "left_semi"))
    # values of a document from the rarest on, each with the weight of itself and of all that follow
    along = Window.partitionBy("d").orderBy("n", "v")
    values = one.select("d", "v", "w", F.row_number().over(along).alias("at"), F.sum("w").over(along.rowsBetween(0, Window.unboundedFollowing)).alias("left"))
    values = cut(values)
    sets = values.where(F.col("left") >= goal).select("d", F.col("v").alias("s"), "w", "at")
    pairs_of: list[DataFrame] = []
    while True:
        held = cut(sets.groupBy("s").agg(F.count("*").alias("n"), F.min("d").alias("hub"), F.min("w").alias("weight")).where("n > 1"))
        here = cut(join_counted(cut(sets), held, "s"))
        links.append(here.where(F.col("w") >= goal).select("hub", "d"))
        few = here.where((F.col("w") < goal) & (F.col("n") <= FEW_HOLDERS)).select("s", "d")
        pairs_of.append(few.join(few.withColumnRenamed("d", "e"), "s").where("d < e").select("d", "e"))
        more = here.where((F.col("w") < goal) & (F.col("n") > FEW_HOLDERS)).select("d", "s", F.col("w").alias("so_far"), F.col("at").alias("last"))
        if more.isEmpty():
            break
        grown = more.join(values, "d").where((F.col("at") > F.col("last")) & (F.col("so_far") + F.col("left") >= goal))
        sets = grown.select("d", F.concat_ws(" ", "s", "v").alias("s"), (F.col("so_far") + F.col("w")).alias("w"), "at")
    candidates = cut(reduce(DataFrame.unionByName, pairs_of).distinct())
    theirs = candidates.join(values.select("d", "v", "w"), "d").join(values.select(F.col("d").alias("e"), "v"), ["e", "v"])
    links.append(theirs.groupBy("d", "e").agg(F.sum("w").alias("w")).where(F.col("w") >= goal).select(F.col("d").alias("hub"), F.col("e").alias("d")))
    edges = reduce(DataFrame.unionByName, links).where("hub <> d").distinct()
    found = connected_components(edges, "hub", "d")
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def graph_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs with both ends among the nodes, and their strength."""
    from ..functions.scores import strength

    ids = nodes.select("doc_id").distinct()
    both = edges.join(ids.withColumnRenamed("doc_id", "doc_a"), "doc_a", "left_semi").join(ids.withColumnRenamed("doc_id", "doc_b"), "doc_b", "left_semi")
    return both.withColumn("strength", strength(F.col("score")))


def route(scored: DataFrame) -> DataFrame:
    """(doc_id, score) to search: those with strong scores, failing that medium ones, failing that none."""
    best = scored.agg(F.max("score")).first()[0]
    if best is None or best < MEDIUM:
        return scored.select("doc_id", "score").limit(0)
    return scored.where(F.col("score") >= (STRONG if best >= STRONG else MEDIUM)).select("doc_id", "score")


def disambiguate(scored: DataFrame, edges: DataFrame) -> DataFrame:
    """(n_clusters, requires, reason): do the documents that fit a question fall into more than one cluster?"""
    fit = scored.where(F.col("score") >= MEDIUM)
    c = fit.join(clusters(edges), "doc_id", "left").withColumn("cluster", F.coalesce("cluster", "doc_id"))
    n = c.agg(F.count_distinct("cluster").alias("n_clusters"))
    return n.select("n_clusters", (F.col("n_clusters") > 1).alias("requires"), F.when(F.col("n_clusters") == 0, "no_match").when(F.col("n_clusters") == 1, "single_cluster").otherwise("multiple_clusters").alias("reason"))


def replace_document(index: DataFrame, fresh: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The index with all rows of the fresh documents replaced."""
    return index.join(fresh.select(id_col).distinct(), id_col, "left_anti").unionByName(fresh)


def ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
