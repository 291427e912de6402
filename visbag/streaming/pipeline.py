"""The work pipeline as Structured Streaming: routing slips, stages, dead letters, routed sinks.

A stage is a function of an envelope DataFrame (rows of ``visbag.schema.ENVELOPE``) to another, the same in batch and
streaming. There is no state: no watermarks, windows or late data. Delivery is at least once: the checkpoint moves
after a batch's sinks have been written, and each batch overwrites its own folder, so a repeated batch leaves no copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bow, codebook, search
from ..schema import ENVELOPE
from ..sources import envelope

Stage = Callable[[DataFrame], DataFrame]
ERROR = 10


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Envelopes from JSON files that arrive in a folder."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).json(path)


def read_messages(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Serialised envelopes, one a file; ``malformed`` marks what cannot be read."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

    binary = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
    files = spark.readStream.schema(binary).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(path)
    return envelope.decode(files.select(F.col("content").alias("value")))


def head() -> Column:
    return F.try_element_at("configuration", F.lit(1))


def routed(envelopes: DataFrame) -> DataFrame:
    """The slip moves on: the first configuration joins the past ones; ``next_queue`` is the new first one's queue, or
    the return queue. An envelope without configuration gets error ERROR and goes to its return queue."""
    none = F.size(F.coalesce("configuration", F.expr("array()"))) <= 0
    past = F.when(none, F.col("pastConfiguration")).otherwise(F.concat(F.coalesce("pastConfiguration", F.slice("configuration", 1, 0)), F.slice("configuration", 1, 1)))
    rest = F.when(none, F.col("configuration")).otherwise(F.slice("configuration", 2, F.greatest(F.size("configuration"), F.lit(1))))
    out = envelopes.withColumns({"errorCode": F.when(none, F.lit(ERROR)).otherwise(F.coalesce("errorCode", F.lit(0))), "pastConfiguration": past, "configuration": rest})
    return out.withColumn("next_queue", F.coalesce(head().queue, F.col("returnQueue")))


def failed(envelopes: DataFrame, when: Column, message: str) -> DataFrame:
    """Where ``when`` holds: error ERROR and a message; the envelope goes on."""
    return envelopes.withColumns({
        "errorCode": F.when(when, F.lit(ERROR)).otherwise(F.coalesce("errorCode", F.lit(0))),
        "message": F.when(when, F.concat(F.coalesce("message", F.array().cast("array<string>")), F.array(F.lit(message)))).otherwise(F.col("message")),
    })


def dead_letters(envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(envelopes to process, dead letters): malformed ones, and those with neither configuration nor return queue."""
    dead = F.coalesce(F.col("malformed"), F.lit(False)) if "malformed" in envelopes.columns else F.lit(False)
    dead = dead | ((F.size(F.coalesce("configuration", F.expr("array()"))) <= 0) & F.col("returnQueue").isNull())
    return envelopes.where(~dead), envelopes.where(dead)


def extraction_stage(extract) -> Stage:
    """Image to blob of feature rows; the image is dropped; without an extractor's result the blob is null."""

    def stage(envelopes: DataFrame) -> DataFrame:
        features = envelope.extracted(envelopes.select(F.xxhash64("uuid").alias("image_id"), "image"), extract)
        row = F.concat(F.array(*(F.col(c) for c in ("x", "y", "size", "angle", "response", "octave"))), "descriptor")
        blobs = envelope.blobs(features.select("image_id", "feature_id", row.alias("values")), "image_id", "feature_id", "values")
        out = envelopes.drop("blob").withColumn("image_id", F.xxhash64("uuid")).join(blobs, "image_id", "left").drop("image_id")
        out = failed(out, F.col("blob").isNull() | head().fe.isNull(), "no features")
        return out.withColumn("image", F.lit(None).cast("binary"))

    return stage


def words_stage(book: DataFrame, sigma: float, k: int = codebook.NEIGHBOURS) -> Stage:
    """Blob of features to blob of soft-assigned words: the six header values, then (word, weight) pairs, as many as
    the request's neighborCount says (``k`` if it has none)."""
    n = book.count()
    spark = book.sparkSession

    def stage(envelopes: DataFrame) -> DataFrame:
        wanted = F.coalesce(F.when(head().translate.neighborCount > 0, head().translate.neighborCount), F.lit(k)).cast("int")
        most = envelopes.agg(F.max(wanted)).first()[0] or k
        rows = envelope.header_and_descriptor(envelope.matrix_rows(envelopes.withColumn("_k", wanted), "blob", "uuid", "_k"))
        found = codebook.nearest(rows.where(F.size("descriptor") > 0), book, min(most, n))
        found = found.withColumns({c: F.slice(c, 1, F.col("_k")) for c in ("words", "distances")})
        soft = bow.soft_assigned(found, spark.createDataFrame([(float(sigma),)], "s double"))
        pairs = F.flatten(F.transform(F.arrays_zip("words", "weights"), lambda s: F.array((s.words + 1).cast("float"), s.weights.cast("float"))))
        values = F.concat(F.array(*(F.col(c) for c in ("x", "y", "size", "angle", "response", "octave"))), pairs)
        blobs = envelope.blobs(soft.select("uuid", "row", values.alias("values")), "uuid", "row", "values", n)
        out = envelopes.drop("blob").join(blobs, "uuid", "left")
        return failed(out, head().translate.isNull(), "no translate configuration")

    return stage


def search_stage(base: DataFrame, names: DataFrame, mode: str = "reference", databases: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> Stage:
    """Blob of words to a result list, ``listSize`` long (100 if absent), from the request's database: one of
    ``databases``, or ``base`` and ``names`` where it names none; an unknown one is an error. ``base``: id, word, value;
    ``names``: item_id, name."""
    known = {"": (base, names)} | (databases or {})

    def stage(envelopes: DataFrame) -> DataFrame:
        asked = F.coalesce(head().match.database, F.lit(""))
        size = F.coalesce(head().match.listSize, F.lit(search.LIST_SIZE))
        sizes = envelopes.select(F.col("uuid").alias("query_id"), size.alias("list_size"))
        most = {r.d: r.n for r in envelopes.groupBy(asked.alias("d")).agg(F.max(size).alias("n")).where(F.col("d").isin(*known)).collect()}
        found = None
        for name, limit in sorted(most.items()):
            rows = envelope.matrix_rows(envelopes.where(asked == name), "blob", "uuid")
            flat = rows.select("uuid", F.explode(F.expr("sequence(6, size(values) - 2, 2)")).alias("i"), "values").where("size(values) > 7")
            terms = flat.select("uuid", F.get("values", F.col("i")).cast("int").alias("word"), F.get("values", F.col("i") + 1).cast("double").alias("weight"))
            hist = bow.histogram(terms.withColumnRenamed("uuid", "image_id")).select(F.col("image_id").alias("id"), "word", "value")
            ranking = search.top(hist, known[name][0], mode, list_size=limit).join(sizes, "query_id").where("rank <= list_size").drop("list_size")
            lists = search.result_lists(ranking, known[name][1]).select(F.col("query_id").alias("uuid"), "result")
            found = lists if found is None else found.unionByName(lists)
        out = envelopes.drop("result").join(found, "uuid", "left") if found is not None else envelopes
        out = failed(out, head().match.isNull(), "no match configuration")
        return failed(out, head().match.isNotNull() & ~asked.isin(*known), "unknown database")

    return stage


def run(envelopes: DataFrame, stages: list[Stage]) -> DataFrame:
    """Each stage and then the slip's next step."""
    for stage in stages:
        envelopes = routed(stage(envelopes).select(*(f.name for f in ENVELOPE.fields)))
    return envelopes


def start(envelopes: DataFrame, stages: list[Stage], out: str, dead: str, checkpoint: str, once: bool = False):
    """A running query: each batch goes through the stages, to a folder for each next queue; the dead letters apart.
    ``once``: it ends when what is there has been taken."""

    def batch(rows: DataFrame, number: int) -> None:
        alive, lost = dead_letters(rows)
        ids = [f.name for f in ENVELOPE.fields]
        run(alive.select(*ids), stages).write.mode("overwrite").partitionBy("next_queue").json(f"{out}/batch={number}")
        lost.select(*ids).write.mode("overwrite").json(f"{dead}/batch={number}")

    writer = envelopes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
