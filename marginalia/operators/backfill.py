"""The graph's tables brought up to date: documents and entities first, then claims and evidence by their ids.

Each table is upserted by its key: a row that is there keeps its id and the time when it was first written, one whose
values differ takes the new ones. Claims then point to ids of entities, and evidence to ids of documents, entities and
claims, by joins with the upserted tables; what points to nothing is told by a null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from . import graph as G

KEYS = {"documents": "document_key", "entities": "entity_key", "claims": "claim_key", "evidence": "evidence_key"}

#: What an upsert adds to a table's own columns.
ADDED = ("row_id", "first_written", "last_written", "state")


def hashed(columns: list[str]) -> Column:
    return F.xxhash64(*[F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit("")) for c in columns])


def upserted(old: DataFrame | None, new: DataFrame, key: str, at: str) -> DataFrame:
    """``old`` with ``new``: state is added, changed, same (there and alike) or kept (not in ``new``).

    Keys are unique in each. ``at``: the time of this writing. row_id follows from the key when a row is first written.
    """
    columns = [c for c in new.columns if c not in ADDED]
    values = [c for c in columns if c != key]
    time = F.lit(at).cast("timestamp_ntz")
    fresh = new.select(F.col(key), F.struct(*values).alias("now"), hashed(values).alias("now_hash"))
    if old is None:
        was = new.sparkSession.createDataFrame([], new.select(*columns).schema).select("*", F.lit("").alias("row_id"), time.alias("first_written"), time.alias("last_written"))
    else:
        was = old.select(*columns, "row_id", "first_written", "last_written")
    was = was.select(F.col(key), F.struct(*values).alias("was"), hashed(values).alias("was_hash"), "row_id", "first_written", "last_written")
    both = fresh.join(was, key, "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "kept").when(F.col("now_hash") == F.col("was_hash"), "same").otherwise("changed")
    both = both.withColumn("state", state).withColumn("row", F.when(F.col("now").isNull(), F.col("was")).otherwise(F.col("now")))
    written = F.col("state").isin("added", "changed")
    return both.select(
        key, *[F.col(f"row.{c}").alias(c) for c in values], F.coalesce("row_id", F.md5(key)).alias("row_id"), F.coalesce("first_written", time).alias("first_written"),
        F.when(written, time).otherwise(F.col("last_written")).alias("last_written"), "state",
    )


def linked(rows: DataFrame, table: DataFrame, key: str, by: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the row_id in ``table`` of what the column ``by`` names; null where it names nothing there."""
    ids = table.select(F.col(key).alias("_key"), F.col("row_id").alias(name))
    return rows.join(ids, F.col(by) == F.col("_key"), "left").drop("_key")


def brought_up(items: DataFrame, at: str, old: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The four tables as of ``items`` (with url), written; ``old``: those of an earlier call, or none."""
    before = (old or {}).get
    out = {}
    for name, make in (("documents", G.documents), ("entities", G.entities)):
        out[name] = stored(upserted(before(name), make(items), KEYS[name], at), name=name)
    claims = linked(linked(G.claims(items), out["entities"], "entity_key", "subject_key", "subject_id"), out["entities"], "entity_key", "object_key", "object_id")
    out["claims"] = stored(upserted(before("claims"), claims, "claim_key", at), name="claims")
    evidence = linked(G.evidence(items), out["documents"], "document_key", "document_key", "document_id")
    targets = out["entities"].select(F.col("entity_key").alias("key"), "row_id").unionByName(out["claims"].select(F.col("claim_key").alias("key"), "row_id"))
    evidence = linked(evidence, targets, "key", "target_key", "target_id")
    out["evidence"] = stored(upserted(before("evidence"), evidence, "evidence_key", at), name="evidence")
    return out
