"""SentencePiece encoding and decoding: exact merges by backtracking over Aho-Corasick matches.

The encoder is in `bpe`. The model file is read on the driver and goes to the workers as a broadcast
of its half megabyte, so executors need no copy of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from pathlib import Path

from pyspark.sql import DataFrame

from .bpe import load_model
from .texts import map_texts


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ids of every whole text: (id, *keep, ids array<int>[, decoded string]).

    Null and empty texts have no ids and decode to "". Rows with equal ids or texts stay rows; an
    empty table gives an empty table. Columns outside id, text and `keep` are not read.
    """
    blob = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def work(slices) -> Iterator[dict]:
        model = load_model(blob.value)
        for _, texts in slices:
            ids = [model.encode(t) for t in texts]
            yield {"ids": ids} | ({"decoded": [model.decode(i) for i in ids]} if decode else {})
        model.forget()

    return map_texts(df, id_col, text_col, "ids array<int>" + ", decoded string" * decode, work, keep)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: (id, text). Null and empty lists give ""; an id outside the model fails."""
    from pyspark.sql import functions as F

    blob = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())
    source = df.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def batches(rows):
        import pyarrow as pa

        model = load_model(blob.value)
        for batch in rows:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.decode(i or ()) for i in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return source.mapInArrow(batches, f"`{id_col}` {source.schema['id'].dataType.simpleString()}, text string")


def digests(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every whole text: what `encode` and `decode`
    give, hashed where it is made, so that no ids leave the workers. Null is as empty."""
    blob = df.sparkSession.sparkContext.broadcast(Path(model_path).read_bytes())

    def work(slices) -> Iterator[dict]:
        model = load_model(blob.value)
        name = list(map(str, range(len(model.pieces))))
        for _, texts in slices:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in texts:
                ids = model.encode(t)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(",".join(map(name.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(sha256(model.decode(ids).encode()).hexdigest())
            yield out
        model.forget()

    return map_texts(df, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", work)
