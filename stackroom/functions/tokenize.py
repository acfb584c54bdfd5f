"""Fixed-length token ids for joint text-image models, from a vocabulary file of a public tokeniser."""

from __future__ import annotations

from pyspark.sql import DataFrame

LENGTH = 77


def joint_token_ids(rows: DataFrame, vocabulary: str, *, id_col: str = "file_id", text_col: str = "text", length: int = LENGTH, start: str = "<|startoftext|>", end: str = "<|endoftext|>") -> DataFrame:
    """``(id, ids)``: start token, at most ``length - 2`` tokens of the lower-cased text, end token, zeros.

    ``vocabulary`` is a tokenizer JSON file; the driver reads it and ships its text, so executors
    need no path. Special tokens' strings in a text are ordinary text. Null texts have no tokens.
    """
    with open(vocabulary, encoding="utf-8") as f:
        source = f.read()
    shipped = rows.sparkSession.sparkContext.broadcast(source)  # a vocabulary file: a few MB, whatever the rows

    def run(batches):
        import pyarrow as pa
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(shipped.value)
        tok.encode_special_tokens = True
        first, last = tok.token_to_id(start), tok.token_to_id(end)
        for batch in batches:
            out = []
            for e in tok.encode_batch([(t or "").lower() for t in batch.column(1).to_pylist()], add_special_tokens=False):
                body = e.ids[: length - 2]
                out.append([first, *body, last, *[0] * (length - 2 - len(body))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {dict(rows.dtypes)[id_col]}, ids array<int>")
