"""Key-based upserts of snapshots: last row of a batch wins, only some columns change, nothing is lost."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrill.storage import drop_folder, get_text, names_in, no_shuffles_left, put_text

# What a post must have, and what a later fetch changes.
REQUIRED = ["source", "external_id", "title", "posted_at"]
UPDATED = ["title", "content", "score", "num_comments", "flair", "over_18"]
KEY = ["source", "external_id"]


def last_wins(batch: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row of each key, the last in the order; a partial aggregation, so that no key's rows meet in one sort."""
    return batch.groupBy(*key).agg(F.max_by(F.struct(*batch.columns), order).alias("_r")).select("_r.*")


def valid(batch: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with all required fields, and the skipped ones."""
    whole = F.lit(True)
    for c in required:
        whole = whole & F.col(c).isNotNull()
    return batch.filter(whole), batch.filter(~whole)


def merged(stored: DataFrame, batch: DataFrame, key: list[str], updated: list[str]) -> DataFrame:
    """stored after the upsert of a batch with one row for each key: known keys take the batch's `updated` columns, new keys the whole row."""
    new = batch.select(*[F.col(c).alias(f"_n_{c}") for c in batch.columns])
    match = [F.col(c) == F.col(f"_n_{c}") for c in key]
    both = stored.withColumn("_known", F.lit(True)).join(new.withColumn("_new", F.lit(True)), match, "full_outer")
    columns = []
    for c in stored.columns:
        if c not in batch.columns:
            columns.append(F.col(c))
        elif c in updated:
            columns.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return both.select(*columns)


def new_links(links: DataFrame, stored: DataFrame, dim: DataFrame) -> DataFrame:
    """(post_id, model_id) of links (post_id, slug) that aren't stored yet; unknown slugs drop out, repeated ones count once."""
    known = links.join(F.broadcast(dim.select(F.col("id").alias("model_id"), "slug")), "slug").select("post_id", "model_id").distinct()
    return known.join(stored.select("post_id", "model_id"), ["post_id", "model_id"], "left_anti")


def releases_upserted(stored: DataFrame, batch: DataFrame, models: DataFrame, order: Column) -> DataFrame:
    """stored releases after the upsert of a batch that names models by slug: an unknown slug stays with a null model_id. A known (source, external_id) takes
    the batch's title, url, version, extra and model."""
    dim = models.select(F.col("id").alias("model_id"), F.col("slug").alias("model"))
    named = last_wins(batch, KEY, order).join(F.broadcast(dim), "model", "left").drop("model")
    return merged(stored, named, KEY, ["title", "url", "version", "extra", "model_id"])


def seeded(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """The models after a seed run: known slugs take name, company, role and aliases, new ones come in."""
    return merged(stored, seeds, ["slug"], ["name", "company", "role", "aliases"])


class Snapshots:
    """A table as folders of key buckets, and small numbered manifests that tell which folder holds which bucket. Readers see the last
    complete version; an upsert reads and rewrites the buckets that its keys fall in, and no others; a lost writer leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets

    def version(self) -> int:
        return max((int(n.split(".")[0]) for n in names_in(self.spark, f"{self.path}/manifests") if n.endswith(".json")), default=0)

    def _manifest(self) -> dict:
        k = self.version()
        return json.loads(get_text(self.spark, f"{self.path}/manifests/{k:08d}.json")) if k else {"buckets": self.buckets, "key": None, "folders": {}}

    def _read(self, folders: dict[str, str], buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, folder in folders.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self._manifest()["folders"])

    def _commit(self, rows: DataFrame, key: list[str], kept: dict[str, str], buckets: int) -> int:
        k, token = self.version() + 1, uuid.uuid4().hex[:12]
        placed = rows.withColumn("bucket", F.pmod(F.hash(*key), F.lit(buckets)))
        with no_shuffles_left(self.spark):
            placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{token}")
        new = {n.split("=")[1]: token for n in names_in(self.spark, f"{self.path}/{token}") if n.startswith("bucket=")}
        old = set(self._manifest()["folders"].values())
        put_text(self.spark, f"{self.path}/manifests/{k:08d}.json", json.dumps({"buckets": buckets, "key": key, "folders": {**kept, **new}}))
        # Folders that neither this version nor the one before uses are gone from the next version on.
        for name in names_in(self.spark, self.path):
            if name not in {"manifests", *kept.values(), token, *old}:
                drop_folder(self.spark, f"{self.path}/{name}")
        return k

    def write(self, rows: DataFrame, key: list[str]) -> int:
        """Replaces the whole table."""
        return self._commit(rows, key, {}, self.buckets)

    def upsert(self, batch: DataFrame, key: list[str], updated: list[str], required: list[str], order: Column) -> int:
        """Upserts a batch and returns how many rows were skipped for missing fields. Running it again changes nothing."""
        good, skipped = valid(batch, required)
        state = self._manifest()
        if state["key"] not in (None, key):
            raise ValueError(f"the table is kept by {state['key']}")
        new = last_wins(good, key, order)
        bucket = F.pmod(F.hash(*key), F.lit(state["buckets"]))
        # At most as many numbers as there are buckets.
        touched = [r.b for r in good.select(bucket.alias("b")).distinct().collect()]
        if touched:
            kept = {b: f for b, f in state["folders"].items() if int(b) not in touched}
            self._commit(merged(self._read(state["folders"], touched), new, key, updated), key, kept, state["buckets"])
        return skipped.count()
