"""Knowledge graph: merging of extracted entities and relations, communities, their context.

entities: (chunk_ix, chunk_id, ent_ix, name, type, description); relations: (chunk_ix, chunk_id, rel_ix, source, target, description, weight); chunk_ix and ent_ix / rel_ix give the order in which things were first seen.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def _ordered_distinct(df: DataFrame, by: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """by and an array of the distinct non-empty values of each group in first-seen order."""
    first = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*by, value).agg(F.min(F.struct(*order)).alias("o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", value))), lambda x: x[value]).alias(out))


def kept(rows: DataFrame) -> DataFrame:
    """rows without those of chunks that are reference lists, where a column says so."""
    return rows.where(~F.coalesce("is_reference_list", F.lit(False))) if "is_reference_list" in rows.columns else rows


def mentions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Every touch of a node in order: entities of a chunk before the ends of its relations, which vote for the type concept."""
    entities, relations = kept(entities), kept(relations)
    e = entities.select("chunk_ix", "chunk_id", F.col("ent_ix").alias("ix"), F.lit(0).alias("part"), "name", "type", "description")
    ends = [relations.select("chunk_ix", "chunk_id", (F.col("rel_ix") + 1_000_000).alias("ix"), F.lit(p).alias("part"), F.col(c).alias("name"), F.lit("concept").alias("type"), F.lit("").alias("description")) for p, c in ((0, "source"), (1, "target"))]
    return e.union(ends[0]).union(ends[1]).withColumn("node", T.norm_name(F.col("name"))).where("node <> ''")


def nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(node, display, type, descriptions, chunk_ids): nodes by normal name; type is the most frequent, the first seen among equals."""
    m = mentions(entities, relations)
    order = ["chunk_ix", "ix", "part"]
    display = m.groupBy("node").agg(F.min(F.struct(*order, "name"))["name"].alias("display"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    votes = m.groupBy("node", "type").agg(F.count("*").alias("c"), F.min(F.struct(*order)).alias("first"))
    n = F.row_number().over(W.partitionBy("node").orderBy(F.desc("c"), "first"))
    kind = votes.withColumn("n", n).where("n = 1").select("node", "type")
    described = _ordered_distinct(m, ["node"], "description", order, "descriptions")
    out = display.join(kind, "node").join(described, "node", "left")
    return out.select("node", "display", "type", F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"), "chunk_ids")


def edges(relations: DataFrame) -> DataFrame:
    """(a, b, weight, descriptions, chunk_ids): undirected edges between different nodes, weights summed."""
    r = kept(relations).withColumn("s", T.norm_name(F.col("source"))).withColumn("t", T.norm_name(F.col("target"))).where("s <> '' AND t <> '' AND s <> t")
    r = r.withColumn("a", F.least("s", "t")).withColumn("b", F.greatest("s", "t"))
    sums = r.groupBy("a", "b").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    described = _ordered_distinct(r, ["a", "b"], "description", ["chunk_ix", "rel_ix"], "descriptions")
    return sums.join(described, ["a", "b"], "left").select("a", "b", "weight", F.coalesce("descriptions", F.array().cast("array<string>")).alias("descriptions"), "chunk_ids")


def metrics(nodes: DataFrame, edges: DataFrame, n_chunks: int) -> DataFrame:
    """One row: nodes, edges, isolated share, entities a chunk."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    alone = nodes.join(ends, "node", "left_anti").agg(F.count("*").alias("alone"))
    return nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(alone)).join(F.broadcast(edges.agg(F.count("*").alias("edges")))).select(
        "nodes", "edges", F.try_divide("alone", "nodes").alias("isolated"), (F.col("nodes") / F.lit(max(1, n_chunks))).alias("entities_per_chunk")
    )


def _checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillflow-"))
    return df.checkpoint()


#: Most ends of edges, and most nodes, whose rounds run within one task.
ONE_TASK = 2_000_000


def _rounds_in_task(total: float, rounds: int):
    """From rows (u, v, w, odd), nodes with their degree where v is null and ends of edges otherwise, to (node, community): the rounds of communities on arrays.  Numbers of nodes are in the order of their names."""

    def run(batches):
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        if not t.num_rows:
            return
        is_node = pc.is_null(t["v"])
        own, ends = t.filter(is_node), t.filter(pc.invert(is_node))
        own = own.take(pc.sort_indices(own["u"]))
        names, n = own["u"], own.num_rows
        k, odd = own["w"].to_numpy(), own["odd"].to_numpy()
        u, v = (pc.index_in(ends[x], value_set=names) for x in ("u", "v"))
        known = pc.and_(pc.is_valid(u), pc.is_valid(v))
        u, v = (x.filter(known).to_numpy().astype(np.int64) for x in (u, v))
        weight = ends["w"].filter(known).to_numpy()
        c, quiet = np.arange(n), 0
        for r in range(2 * rounds):
            if not total or quiet > 1 or not len(u):
                break
            size = np.bincount(c, weights=k, minlength=n)
            pair, which = np.unique(u * n + c[v], return_inverse=True)
            w, at, to = np.bincount(which, weights=weight), pair // n, pair % n
            here = to == c[at]
            gain = np.round(w - k[at] * (size[to] - np.where(here, k[at], 0.0)) / total, 9)
            order = np.lexsort((to, here, gain, at))
            best = order[np.append(np.flatnonzero(np.diff(at[order])), len(order) - 1)]
            stay = np.zeros(n)
            stay[at[here]] = gain[here]
            best = best[(odd[at[best]] == r % 2) & (gain[best] > stay[at[best]])]
            quiet = 0 if np.any(c[at[best]] != to[best]) else quiet + 1
            c[at[best]] = to[best]
        label, first, back = np.unique(c, return_index=True, return_inverse=True)
        community = names.take(pa.array(first[back]))
        yield from pa.table({"node": names, "community": community}).to_batches(10_000)

    return run


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 10, one_task: int = ONE_TASK) -> DataFrame:
    """(node, community): greedy modularity by local moves, from singletons.

    In every round each node weighs the communities of its neighbours by modularity gain and
    moves to the best; to keep two neighbours from swapping, only nodes of one parity
    of a hash move in a round.  A community is named by its smallest member.  A graph of one_task
    ends of edges and nodes at most goes through its rounds in one task, a larger one in joins.
    """
    # the rounds read edges from a file, not from what they were made of
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v"), "weight"), F.struct(F.col("b").alias("u"), F.col("a").alias("v"), "weight"))
    both = _checkpointed(edges.select(F.inline(ends)))
    degree = both.groupBy("u").agg(F.sum("weight").alias("k"))
    total = degree.agg(F.coalesce(F.sum("k"), F.lit(0.0))).first()[0]
    lab = _checkpointed(nodes.select("node").join(degree, F.col("node") == F.col("u"), "left").select("node", F.coalesce("k", F.lit(0.0)).alias("k"), F.col("node").alias("c")))
    if both.count() <= one_task and lab.count() <= one_task:
        rows = lab.select(F.col("node").alias("u"), F.lit(None).cast("string").alias("v"), F.col("k").cast("double").alias("w"), F.pmod(F.xxhash64("node"), F.lit(2)).alias("odd"))
        rows = rows.union(both.select("u", "v", F.col("weight").cast("double"), F.lit(0).cast("bigint")))
        return rows.coalesce(1).mapInArrow(_rounds_in_task(float(total), rounds), "node string, community string")
    quiet = 0
    for r in range(2 * rounds):
        if not total or quiet > 1:
            break
        size = lab.groupBy("c").agg(F.sum("k").alias("s")).withColumnRenamed("c", "c_")
        links = both.join(lab.select(F.col("node").alias("v"), F.col("c").alias("nc")), "v").groupBy("u", "nc").agg(F.sum("weight").alias("w"))
        options = lab.join(links, F.col("node") == F.col("u")).join(size, F.col("nc") == F.col("c_"))
        own = F.when(F.col("nc") == F.col("c"), F.col("s") - F.col("k")).otherwise(F.col("s"))
        gain = F.round(F.col("w") - F.col("k") * own / F.lit(total), 9)
        best = options.groupBy("node").agg(F.max_by("nc", F.struct(gain, F.col("nc") == F.col("c"), F.col("nc"))).alias("to"), F.max(gain).alias("g"), F.max(F.when(F.col("nc") == F.col("c"), gain)).alias("stay"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        move = turn & F.col("to").isNotNull() & (F.col("g") > F.coalesce("stay", F.lit(0.0)))
        new = _checkpointed(lab.join(best, "node", "left").select("node", "k", F.col("c").alias("old"), F.when(move, F.col("to")).otherwise(F.col("c")).alias("c")))
        quiet = 0 if new.where("old <> c").limit(1).count() else quiet + 1
        lab = new.select("node", "k", "c")
    names = lab.groupBy("c").agg(F.min("node").alias("community"))
    return lab.join(names, "c").select("node", "community")


def community_context(members: DataFrame, nodes: DataFrame, edges: DataFrame, cap: int = 3000) -> DataFrame:
    """(community, context): members with their first description, then the edges inside, cap characters at most."""
    m = members.join(nodes, "node")
    lines = m.select("community", F.lit(0).alias("kind"), F.col("node").alias("o"), F.concat_ws(": ", "display", F.get("descriptions", F.lit(0))).alias("line"))
    inside = edges.join(members.select(F.col("node").alias("a"), "community"), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("community = cb")
    lines = lines.union(inside.select("community", F.lit(1), F.concat_ws("|", "a", "b"), F.concat_ws(" - ", "a", "b")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "o", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("community").agg(F.substring(text, 1, cap).alias("context"))


ENTITY = "STRUCT<name: STRING, type: STRING, description: STRING>"
RELATION = "STRUCT<source: STRING, target: STRING, description: STRING, weight: DOUBLE>"


def parse_extraction(raw: DataFrame) -> DataFrame:
    """(chunk_id, is_reference_list, entities, relations) from model answers (chunk_id, answer): the outermost braces, with or without a fence; what does not parse is empty; nameless items go; weights are held to 0..10."""
    body = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    j = F.from_json(body, f"STRUCT<is_reference_list: BOOLEAN, entities: ARRAY<{ENTITY}>, relations: ARRAY<{RELATION}>>")
    p = raw.withColumn("j", j)
    ents = F.filter(F.coalesce("j.entities", F.array().cast(f"ARRAY<{ENTITY}>")), lambda e: F.trim(F.coalesce(e["name"], F.lit(""))) != "")
    rels = F.filter(F.coalesce("j.relations", F.array().cast(f"ARRAY<{RELATION}>")), lambda r: (F.trim(F.coalesce(r["source"], F.lit(""))) != "") & (F.trim(F.coalesce(r["target"], F.lit(""))) != ""))
    rels = F.transform(rels, lambda r: r.withField("weight", F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.coalesce(r["weight"], F.lit(1.0))))))
    return p.select("chunk_id", F.coalesce("j.is_reference_list", F.lit(False)).alias("is_reference_list"), ents.alias("entities"), rels.alias("relations"))
