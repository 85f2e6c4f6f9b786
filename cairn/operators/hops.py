"""All that a lineage walk may step over: declared loads, parts of composites, queries, look-ups and extracts as typed hops, and the types of their ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import edges_of

#: Kinds of objects by the codes of a transformation's ends.
TYPES = {"ODSO": "dso", "ADSO": "adso", "CUBE": "infocube", "IOBJ": "infoobject", "HCPR": "compositeprovider", "RSDS": "datasource", "MPRO": "multiprovider", "DEST": "openhub", "TRCS": "infosource"}
#: How many queries of one provider a walk takes up.
MOST_QUERIES = 250
COLUMNS = ["src", "dst", "kind", "free", "confidence", "note"]


def hop(df: DataFrame, src: Column, dst: Column, kind: str, free: bool, confidence: Column | str = "exact", note: Column | None = None) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, str) else confidence
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(free).alias("free"), sure.alias("confidence"), (F.lit("") if note is None else note).alias("note"))


def load_hops(transformations: DataFrame, loads: DataFrame) -> DataFrame:
    """Transformations (src, dst), and loads (src, tgt) between ends that no transformation declares."""
    declared = edges_of(transformations)
    other = edges_of(loads, "src", "tgt").join(declared, ["src", "dst"], "left_anti")
    return hop(declared, F.col("src"), F.col("dst"), "transformation", False).unionByName(hop(other, F.col("src"), F.col("dst"), "dtp", False))


def part_hops(parts: DataFrame) -> DataFrame:
    """From each part to its composite (composite, part, confirmed, via): declared by its model where via is null, else by the base tables of its
    generated view, exact only if a catalogue knows the part. A composite is not its own part."""
    other = parts.where("upper(trim(part)) <> upper(trim(composite))")
    sure = F.when(F.col("via").isNull() | F.col("confirmed"), "exact").otherwise("advisory")
    return hop(other, F.col("part"), F.col("composite"), "composite_part", True, sure, F.coalesce("via", F.lit("")))


def query_hops(assigned: DataFrame, roots: DataFrame, most: int = MOST_QUERIES) -> DataFrame:
    """From each provider to the queries that are declared on it (provider, component); only components that are root elements of queries
    (component) count, as structures and key figures are assigned too. Of one provider the first `most` by name are taken up, and note
    tells how many more there are."""
    found = assigned.join(roots.select("component").distinct(), "component", "left_semi").select("provider", "component").distinct()
    own = Window.partitionBy("provider")
    ranked = found.withColumn("n", F.row_number().over(own.orderBy("component"))).withColumn("more", F.count("*").over(own) - most).where(F.col("n") <= most)
    return hop(ranked, F.col("provider"), F.col("component"), "query_provider", True, note=F.when(F.col("more") > 0, F.concat(F.lit("+"), F.col("more").cast("string"))).otherwise(""))


def lookup_hops(declared: DataFrame, parsed: DataFrame) -> DataFrame:
    """From what is looked up to the target whose load looks it up (object, target): exact where a rule declares it, advisory where only the
    routine's code reads it; reading one's own target is no look-up."""
    both = declared.select("object", "target", F.lit(0).alias("way")).unionByName(parsed.select("object", "target", F.lit(1).alias("way"))).where("object <> '' AND target <> '' AND object <> target")
    first = both.groupBy("object", "target").agg(F.min("way").alias("way"))
    return hop(first, F.col("object"), F.col("target"), "lookup", False, F.when(F.col("way") == 0, "exact").otherwise("advisory"))


def extract_hops(extracts: DataFrame) -> DataFrame:
    """From each DataSource's extract structure to the DataSource (datasource, structure, delta); several systems' rows are one hop."""
    known = extracts.where("coalesce(trim(structure), '') <> '' AND coalesce(trim(datasource), '') <> ''").groupBy(F.trim("datasource").alias("d"), F.trim("structure").alias("s")).agg(F.array_join(F.array_sort(F.collect_set("delta")), ",").alias("deltas"))
    return hop(known, F.col("s"), F.col("d"), "source_extract", True, note=F.col("deltas"))


def all_hops(*kinds: DataFrame) -> DataFrame:
    """The hops of all kinds; of one kind between the same ends the exact one counts, then the note that sorts first."""
    every = reduce(DataFrame.unionByName, kinds)
    best = F.min(F.struct((F.col("confidence") != "exact").alias("loose"), "note", "free", "confidence"))
    return every.groupBy("src", "dst", "kind").agg(best.alias("b")).select("src", "dst", "kind", "b.free", "b.confidence", "b.note")


def node_types(hops: DataFrame, ends: DataFrame, composites: DataFrame, queries: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(node, type, basis) of every node of hops: by the codes that transformations give it as a source, then as a target (src, dst, src_type,
    dst_type), then as a composite (name), a query (name), or as the catalogue (name, kind) knows it; else by the hop that found it (an
    extract structure, a query), else unknown. Of several codes the first one that has a meaning counts."""
    meanings = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    code = lambda node, kind: ends.select(F.col(node).alias("node"), meanings[F.upper(F.trim(kind))].alias("type")).where("type IS NOT NULL").groupBy("node").agg(F.min("type").alias("type"))
    nodes = hops.select(F.col("src").alias("node")).union(hops.select("dst")).distinct()
    found = hops.where("kind = 'source_extract'").select(F.col("src").alias("node"), F.lit("extract_structure").alias("type")).union(hops.where("kind = 'query_provider'").select("dst", F.lit("query"))).union(hops.where("kind = 'source_extract'").select("dst", F.lit("datasource")))
    one = lambda df: df.groupBy("node").agg(F.min("type").alias("type"))
    named = lambda df, kind: df.select(F.col("name").alias("node"), kind.alias("type"))
    ways = [
        ("source_code", code("src", "src_type")), ("target_code", code("dst", "dst_type")), ("composite_header", one(named(composites, F.lit("compositeprovider")))), ("query_directory", one(named(queries, F.lit("query")))),
        ("catalogue", one(named(catalogue, F.col("kind")))), ("hop", one(found)),
    ]
    out = nodes
    for basis, known in ways:
        out = out.join(known.select("node", F.struct(F.col("type"), F.lit(basis).alias("basis")).alias(basis)), "node", "left")
    best = F.coalesce(*[b for b, _ in ways], F.struct(F.lit("unknown").alias("type"), F.lit("none").alias("basis")))
    return out.withColumn("b", best).select("node", "b.type", "b.basis")
