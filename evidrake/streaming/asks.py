"""Questions as a stream over a fixed table of documents: the same flow for each micro-batch, with no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index, build_index
from ..operators.versions import IndexStore
from ..plans.ask import ask


def answer_stream(incoming: DataFrame, documents: DataFrame, path: str, checkpoint: str, index: Index | IndexStore | None = None, **options) -> StreamingQuery:
    """Append the responses to ``incoming`` (question_id, question, doc_id) to ``path``; a replayed batch replaces itself.

    The documents are chunked and indexed once, before the stream starts; micro-batches only read the stored index. With an
    :class:`IndexStore` each micro-batch reads its last version, so documents can change while the stream runs; ``documents``
    then serves for the checks of the questions only.
    """
    index = index or build_index(documents, **{k: v for k, v in options.items() if k in ("target", "overlap")})

    def one(batch: DataFrame, number: int) -> None:
        pairs = batch.persist()
        try:
            done = ask(documents, pairs.select("question_id", "question").distinct(), pairs.select("question_id", "doc_id"), index=index.open() if isinstance(index, IndexStore) else index, **options)
            done.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            pairs.unpersist()

    return incoming.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
