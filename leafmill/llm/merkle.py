"""A Merkle manifest of a dataset: one tree for each source, and one over their roots (operator 11).

Leaves are digests of rows. They are dealt into ranges of (source, doc_id), sorted there and
counted, so that every row knows its place among its source's leaves. Each task then runs a
mountain range over every stretch of neighbouring leaves that it has: one open run for each
level, and a run that fills up carries its digest into the level above, as a counter to the
base ``FANOUT`` carries. A run that lies wholly in the stretch is a finished node record; what
is left of others at the two edges of the stretch (at most ``FANOUT`` - 1 nodes a level and
edge) are pieces. Pieces of one run come from several tasks and are merged by one grouping a
level, whose nodes are pieces of the level above. The last run of a level may be short, and is
hashed as it is, without padding. The roots of the sources are leaves of one more such tree.

Proofs go from the top down: a node record hands each child the runs above it, so a path is
made once for all leaves below it. Rows that meet are those of one run, at most ``FANOUT``,
however large a source is. A task keeps one open run for each level.

Defined results: a null field is ``-`` in its leaf; a null source is a source of its own, before
all others; null doc_ids come first in their source and are never tampered with; rows with equal
doc_ids are ordered by their leaves, repeated rows are leaves each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType

from leafmill.llm._common import FEW_FILES, map_batches, materialize, read_table

FANOUT = 16
#: A doc_id whose crc32 this divides has its text tampered with.
TAMPER_EVERY = 5
DIGEST = 32

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def joined_digest(digests: bytes) -> bytes:
    """sha256 of the hex text of concatenated digests."""
    return hashlib.sha256(digests.hex().encode()).digest()


def level_sizes(leaves: int, fanout: int = FANOUT) -> list[int]:
    """How many nodes each level of a tree has, from its leaves to its root."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // fanout))
    return sizes


class MountainRange:
    """Finished runs and pieces of runs over one stretch of neighbouring leaves of a tree.

    ``records`` are (level, parent, at, digests, digest, members): the children of the node
    ``parent`` of the level above from the child ``at`` on; ``digest`` is the parent's own
    where all its children are there, else None; ``members`` are those of leaves.
    """

    def __init__(self, leaves: int):
        self.sizes = level_sizes(leaves)
        self.open: list[tuple[int, list[bytes], list]] = [(0, [], []) for _ in self.sizes]
        self.records: list[tuple] = []

    def push(self, index: int, digest: bytes, member) -> None:
        """The next leaf of the stretch."""
        if self.sizes[0] == 1:
            self.records.append((0, 0, 0, digest, digest, [member]))
            return
        level, members = 0, [member]
        while level < len(self.sizes) - 1:
            start, digests, kept = self.open[level]
            if not digests:
                start = index
            digests.append(digest)
            kept += members
            if (index + 1) % FANOUT and index + 1 < self.sizes[level]:
                self.open[level] = start, digests, kept
                return
            run, whole = b"".join(digests), start % FANOUT == 0
            digest = joined_digest(run) if whole else None
            self.records.append((level, index // FANOUT, start % FANOUT, run, digest, kept))
            self.open[level] = 0, [], []
            if not whole:
                return
            level, index, members = level + 1, index // FANOUT, []

    def close(self) -> None:
        """The stretch ends: what is open becomes pieces."""
        for level, (start, digests, kept) in enumerate(self.open):
            if digests:
                self.records.append((level, start // FANOUT, start % FANOUT, b"".join(digests), None, kept))
                self.open[level] = 0, [], []


_RECORD = "tree string, leaves long, level int, parent long, at int, digests binary, digest binary"


def _climb(indexed: DataFrame, member: DataType) -> DataFrame:
    """Records of a mountain range over each stretch of (tree, leaves, index, digest, member), as the rows come."""
    schema = indexed.sparkSession.createDataFrame([], _RECORD).schema.add("members", ArrayType(member))
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, peaks, done = None, None, []

        def taken() -> None:
            done.extend((*last[:2], *r) for r in peaks.records)
            peaks.records.clear()

        for batch in batches:
            for tree, leaves, index, digest, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or (tree, leaves, index - 1) != last:
                    if peaks is not None:
                        peaks.close()
                        taken()
                    peaks = MountainRange(leaves)
                peaks.push(index, digest, of)
                last = tree, leaves, index
            if peaks is not None:
                taken()
            if done:
                yield _batch(done, arrow)
                done = []
        if peaks is not None:
            peaks.close()
            taken()
            if done:
                yield _batch(done, arrow)

    return map_batches(indexed.select("tree", "leaves", "index", "digest", "member"), run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def indexed_leaves(leaves: DataFrame, order: list[str]) -> DataFrame:
    """(tree, digest, member) with ``index``, the place in its tree by ``order``, and ``leaves``, the tree's number of leaves.

    Rows lie in sorted ranges; only the number of rows of each tree in each range is summed.
    """
    keyed = materialize(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    by = ["tree", *order, "digest", "row"]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = materialize(
        dealt.select("tree", "digest", "member", F.monotonically_increasing_id().alias("at")).withColumn("range", F.shiftright("at", 33)),
        "ranges",
    )
    parts = dealt.groupBy("tree", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = "partition by tree"
    parts = materialize(
        parts.select(
            F.col("tree").alias("t"),
            F.col("range").alias("r"),
            F.expr(f"sum(n) over ({whole} order by range) - n - first").alias("shift"),
            F.expr(f"sum(n) over ({whole})").alias("leaves"),
        ),
        "offsets",
        FEW_FILES,
    )
    return (
        dealt.join(parts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("range") == F.col("r")))
        .select("tree", "leaves", (F.col("at") + F.col("shift")).alias("index"), "digest", "member")
        .sortWithinPartitions("tree", "index")
    )


def _ceil_div(n: Column, by: Column) -> Column:
    return F.call_function("div", n + by - 1, by)


def forest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Every run of every tree over (tree, digest, member, order columns), as a written table.

    Columns: tree, leaves, level, parent, digests (the children's, joined), digest (the parent's)
    and, for leaves, members. A tree of one leaf has one record whose digest is the leaf itself.
    """
    member = leaves.schema["member"].dataType
    records = materialize(_climb(indexed_leaves(leaves, order), member), "records")
    done = records.where("digest is not null").drop("at")
    most = records.agg(F.max("leaves")).first()[0] or 0
    pieces = records.where("digest is null")
    parts, carried = [done], None
    for level in range(len(level_sizes(most)) - 1):
        edge = pieces.where(F.col("level") == level).drop("digest")
        if carried is not None:
            edge = edge.unionByName(carried)
        joined = (
            edge.groupBy("tree", "leaves", "level", "parent")
            .agg(F.array_sort(F.collect_list(F.struct("at", "digests", "members"))).alias("p"))
            .withColumn("digests", F.expr("aggregate(p, x'', (a, x) -> concat(a, x.digests))"))
            .withColumn("digest", F.unhex(F.sha2(F.lower(F.hex("digests")).cast("binary"), 256)))
            .withColumn("members", F.flatten("p.members"))
        )
        merged = materialize(joined.select(*done.columns), "merged", FEW_FILES)
        parts.append(merged)
        carried = merged.where(_ceil_div(F.col("leaves"), F.lit(FANOUT ** (level + 1))) > 1).select(
            "tree",
            "leaves",
            (F.col("level") + 1).alias("level"),
            F.expr(f"parent div {FANOUT}").alias("parent"),
            (F.col("parent") % FANOUT).cast("int").alias("at"),
            F.col("digest").alias("digests"),
            F.array().cast(ArrayType(member)).alias("members"),
        )
    runs = parts[0]
    for part in parts[1:]:
        runs = runs.unionByName(part)
    return runs


def tops(runs: DataFrame) -> DataFrame:
    """The record of each tree's root."""
    return runs.where(_ceil_div(F.col("leaves"), F.expr(f"cast(pow({FANOUT}, level + 1) as long)")) == 1)


_STEPS = "array<struct<at:int,digests:binary>>"


def runs_with_paths(runs: DataFrame, above: DataFrame) -> DataFrame:
    """The runs of leaves, with ``path``: for each run above them (at, digests), from the bottom up.

    ``above`` has for each tree the path over its root and columns to hand down to all of its runs.
    """
    handed = [c for c in above.columns if c not in ("tree", "path")]
    top = tops(runs).select("tree", "level").join(above.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    high = runs.agg(F.max("level")).first()[0] or 0
    paths = None
    for level in range(high, -1, -1):
        reach = top.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("node"), "path", *handed)
        if paths is not None:
            reach = reach.unionByName(paths)
        here = runs.where(F.col("level") == level).join(
            reach.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("node"))
        )
        if level == 0:
            return here.drop("t", "node")
        child = F.explode(F.sequence(F.lit(0), F.expr(f"octet_length(digests) div {DIGEST} - 1").cast("int"))).alias("c")
        paths = here.select(F.col("tree"), "parent", "digests", F.col("path").alias("up"), *handed, child).select(
            "tree",
            (F.col("parent") * FANOUT + F.col("c")).alias("node"),
            F.concat(F.array(F.struct(F.col("c").alias("at"), F.col("digests"))).cast(_STEPS), "up").alias("path"),
            *handed,
        )


def without(run: str, at: int) -> str:
    """The hex text of a run's digests but the one ``at`` a place."""
    return run[: at * 2 * DIGEST] + run[(at + 1) * 2 * DIGEST :]


def folded(leaf: bytes, at: int, run: str | None, steps: list[tuple[int, str]]) -> str:
    """The root that a leaf gives with its siblings; ``run`` is None where it has none."""
    digest = leaf.hex()
    for place, text in ([(at, run)] if run else []) + steps:
        cut = place * 2 * DIGEST
        digest = hashlib.sha256((text[:cut] + digest + text[cut + 2 * DIGEST :]).encode()).hexdigest()
    return digest


_PROOF = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string,"
    " verified boolean, source string, position long"
)


def _proofs(runs: DataFrame, root: bytes) -> DataFrame:
    want = root.hex()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = r["digests"].hex()
                steps = [(s["at"], s["digests"].hex()) for s in r["path"]]
                upper = "".join(without(text, at) for at, text in steps)
                lone = r["leaves"] == 1
                honest = folded(r["digest"], 0, None, steps)
                for i, m in enumerate(r["members"]):
                    leaf = r["digests"][i * DIGEST : (i + 1) * DIGEST]
                    found = honest
                    if m["forged"] is not None:
                        found = folded(m["forged"], i, None if lone else own, steps)
                    proof = hashlib.sha256((without(own, i) + upper).encode()).hexdigest()
                    out.append(
                        (m["doc_id"], leaf.hex(), r["subroot"].hex(), want, proof, found, found == want, r["tree"], r["parent"] * FANOUT + i)
                    )
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in out], arrow)

    schema = runs.sparkSession.createDataFrame([], _PROOF).schema
    names, arrow = schema.names, pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    needed = runs.select("tree", "leaves", "parent", "digests", "digest", "members", "path", "subroot")
    return map_batches(needed, run, schema)


def leaf_digest(text: Column) -> Column:
    """The digest of a row of documents whose text is ``text``."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.unhex(F.sha2(F.concat(*map(field, fields)).cast("binary"), 256))


def merkle_proofs(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """For every row its leaf, its source's root, the root, a digest of its proof, and the root folded from it.

    Where ``tamper`` holds, the folded root comes from the leaf with A-Z of the text in lower case.
    """
    doc_id = F.col("doc_id").cast("long")
    forged = leaf_digest(F.translate("text", _UPPER, _LOWER))
    if tamper is not None:
        forged = F.when(tamper, forged)
    leaves = docs.select(
        F.col("source").alias("tree"),
        doc_id.alias("doc_id"),
        leaf_digest(F.col("text")).alias("digest"),
        F.struct(doc_id.alias("doc_id"), (forged if tamper is not None else F.lit(None).cast("binary")).alias("forged")).alias("member"),
    )
    runs = forest(leaves, ["doc_id"])
    subroots = tops(runs).select("tree", "digest")
    roots = forest(
        subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest", F.struct(F.col("tree").alias("source"), F.col("digest").alias("subroot")).alias("member")),
        ["source"],
    )
    root = tops(roots).select("digest").first()
    if root is None:
        return docs.sparkSession.createDataFrame([], _PROOF)
    none = docs.sparkSession.createDataFrame([("", [])], f"tree string, path {_STEPS}")
    own = F.when(F.col("leaves") > 1, F.array(F.struct(F.col("i").alias("at"), "digests"))).otherwise(F.array()).cast(_STEPS)
    above = (
        runs_with_paths(roots, none)
        .select("leaves", "digests", "path", F.posexplode("members").alias("i", "m"))
        .select(F.col("m.source").alias("tree"), F.col("m.subroot").alias("subroot"), F.concat(own, "path").alias("path"))
    )
    return _proofs(runs_with_paths(runs, above), bytes(root["digest"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0
    return merkle_proofs(read_table(spark, sf_dir, "documents"), F.coalesce(tamper, F.lit(False)))
