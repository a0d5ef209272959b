"""Scene graphs as rows: set scores and bounded paths by joins, from exploded entities and relations.

These are merge joins at every size: files of graphs that are much alike hold a small part of what a broadcast would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.native import match_key
from ..sources.tables import by_value, spread

by_value(__name__)

ENTITIES = "array<struct<id:string,type:string,label:string,bbox:array<double>,attrs:map<string,string>>>"
RELATIONS = "array<struct<src:string,dst:string,type:string,label:string>>"
SCENE = f"grammar string, entities {ENTITIES}, relations {RELATIONS}, meta map<string,string>"
LINKING = ("edge", "flow", "connects")


def from_json(text: Column) -> Column:
    """A scene graph from JSON, with absent fields at their defaults."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))

    def filled(g: Column) -> Column:
        entities = F.transform(none(g["entities"], ENTITIES), lambda e: F.struct(e["id"].alias("id"), e["type"].alias("type"), F.coalesce(e["label"], F.lit("")).alias("label"), e["bbox"].alias("bbox"), F.coalesce(e["attrs"], F.create_map().cast("map<string,string>")).alias("attrs")))
        relations = F.transform(none(g["relations"], RELATIONS), lambda r: F.struct(r["src"].alias("src"), r["dst"].alias("dst"), r["type"].alias("type"), F.coalesce(r["label"], F.lit("")).alias("label")))
        return F.when(g["grammar"].isNotNull(), F.struct(g["grammar"].alias("grammar"), entities.alias("entities"), relations.alias("relations"), F.coalesce(g["meta"], F.create_map().cast("map<string,string>")).alias("meta")))

    return once(F.from_json(text, SCENE), filled)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value computed once a row, however often then reads it: through an array of one element."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def from_triplets(t: Column) -> Column:
    """Entities in order of first sight and one relation per triplet (src, label, dst)."""
    names = F.array_distinct(F.flatten(F.transform(t, lambda x: F.array(x["src"], x["dst"]))))
    return F.struct(
        F.lit("workflow").alias("grammar"),
        F.transform(names, lambda x: F.struct(x.alias("id"), F.lit("node").alias("type"), x.alias("label"))).alias("entities"),
        F.transform(t, lambda x: F.struct(x["src"].alias("src"), x["dst"].alias("dst"), F.lit("edge").alias("type"), x["label"].alias("label"))).alias("relations"),
    )


def entity_keys(graph: Column) -> Column:
    return F.array_distinct(F.transform(graph["entities"], lambda e: match_key(e["type"], e["label"])))


def relation_keys(graph: Column) -> Column:
    """(source key, type, target key); an end without an entity is ("?", ""), of repeated ids the last counts."""
    def end(id_: Column) -> Column:
        found = F.filter(graph["entities"], lambda e: e["id"] == id_)
        known = lambda last: F.coalesce(F.when(last.isNotNull(), match_key(last["type"], last["label"])), F.struct(F.lit("?").alias("type"), F.lit("").alias("label")))
        return once(F.try_element_at(found, F.lit(-1)), known)

    return F.array_distinct(F.transform(graph["relations"], lambda r: F.struct(end(r["src"]).alias("src"), F.lower(r["type"]).alias("type"), end(r["dst"]).alias("dst"))))


def set_scores(predicted: Column, gold: Column) -> Column:
    """(precision, recall, f1) of two arrays as sets; both empty scores 1."""
    p, g = F.array_distinct(predicted), F.array_distinct(gold)
    hit = F.size(F.array_intersect(p, g)).cast("double")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(F.try_divide(hit, F.size(p))), zero(F.try_divide(hit, F.size(g)))
    f1 = zero(F.try_divide(2 * precision * recall, precision + recall))
    both = (F.size(p) == 0) & (F.size(g) == 0)
    one = F.lit(1.0)
    return F.struct(F.when(both, one).otherwise(precision).alias("precision"), F.when(both, one).otherwise(recall).alias("recall"), F.when(both, one).otherwise(f1).alias("f1"))


def paths(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(graph, trail): all simple paths of 1 to hops edges of each graph's distinct edges (graph, src, dst)."""
    edges = spread(edges.select("graph", "src", "dst"), "graph", "src").distinct()
    now = edges.filter("src <> dst").select("graph", F.array("src", "dst").alias("trail"))
    out = now
    for _ in range(hops - 1):
        step = now.withColumn("src", F.element_at("trail", -1)).join(edges.hint("merge"), ["graph", "src"])
        now = step.filter(~F.array_contains("trail", F.col("dst"))).select("graph", F.concat("trail", F.array("dst")).alias("trail"))
        out = out.unionByName(now)
    return out


def reachability(predicted: DataFrame, gold: DataFrame, graphs: DataFrame, hops: int = 3) -> DataFrame:
    """(graph, n_gold, n_hit, reach): the share of gold paths that are predicted; 1 for a graph without gold paths."""
    p, g = (spread(paths(edges, hops), "graph", "trail").distinct() for edges in (predicted, gold))
    p = p.withColumn("hit", F.lit(1))
    per = g.join(p.hint("merge"), ["graph", "trail"], "left").groupBy("graph").agg(F.count("*").alias("n_gold"), F.count("hit").alias("n_hit"))
    zero = F.lit(0).cast("long")
    return spread(graphs.select("graph"), "graph").distinct().join(per.hint("merge"), "graph", "left").select("graph", F.coalesce("n_gold", zero).alias("n_gold"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.col("n_hit") / F.col("n_gold"), F.lit(1.0)).alias("reach"))


def linking_edges(df: DataFrame, graph: str = "graph", col: str = "scene") -> DataFrame:
    """Edges between entity keys of linking relations whose ends both exist."""
    return key_edges(df.select(F.col(graph).alias("graph"), relation_keys(F.col(col)).alias("keys")), "keys")


def spatial(scored: DataFrame) -> DataFrame:
    """Rows (graph, predicted, gold) with `spatial`: reachability for gold workflows, else recall of gold relations."""
    rows = scored.filter("graph is not null").withColumns({"_predicted": relation_keys(F.col("predicted")), "_gold": relation_keys(F.col("gold")), "_grammar": F.col("gold.grammar")})
    return spatial_of(rows, "_predicted", "_gold", "_grammar").drop("_predicted", "_gold", "_grammar")


def key_edges(rows: DataFrame, col: str) -> DataFrame:
    """Edges (graph, src, dst) of the linking ones among a column's relation keys whose ends both exist."""
    keyed = rows.select("graph", F.explode(col).alias("r"))
    real = (F.col("r.src.type") != "?") & (F.col("r.dst.type") != "?")
    return keyed.filter(F.col("r.type").isin(*LINKING) & real).select("graph", F.col("r.src").alias("src"), F.col("r.dst").alias("dst")).distinct()


def spatial_of(rows: DataFrame, predicted: str, gold: str, grammar: str) -> DataFrame:
    """rows (graph, relation keys of both sides, the gold grammar; null without a gold graph) with `spatial`. Only keys are
    joined and sorted, never markup or scenes."""
    reach = reachability(key_edges(rows, predicted), key_edges(rows, gold), rows).select("graph", "reach")
    recall = F.when(F.size(gold) == 0, 1.0).otherwise(F.size(F.array_intersect(predicted, gold)) / F.size(gold))
    return spread(rows, "graph").join(reach.hint("merge"), "graph").withColumn("spatial", F.when(F.col(grammar) == "workflow", F.col("reach")).when(F.col(gold).isNotNull(), recall)).drop("reach")
