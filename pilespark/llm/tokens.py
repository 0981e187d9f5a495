"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Bytes of text that one call of the tokenizer encodes, and above which a text is split.
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 16


def load(model: bytes, kind: str):
    """(encoder of a list of texts to a list of lengths, whether texts may be split before a space)."""
    if kind == "json":
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(model.decode("utf-8"))
        t.no_truncation()
        t.no_padding()
        return (lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]), False
    import sentencepiece

    s = sentencepiece.SentencePieceProcessor(model_proto=model)
    # A space turns into U+2581. If no piece holds it after another character, no merge crosses the place before a
    # space; and if spaces are kept and one is put in front, the rest of the text encodes as it does in place.
    pieces = (s.id_to_piece(i) for i in range(s.get_piece_size()))
    crosses = any("▁" in p.lstrip("▁") for p in pieces)
    plain = s.encode("a  b", out_type=str) == s.encode("a", out_type=str) + s.encode(" b", out_type=str) and s.encode("ﬁ") != s.encode("fi")
    return (lambda texts: [len(x) for x in s.encode(texts, num_threads=1)]), plain and not crosses


def split_safely(text: str, most: int) -> list[str]:
    """Parts of about `most` characters, cut at a single space between two other characters."""
    parts, begin = [], 0
    while len(text) - begin > most:
        i = text.find(" ", begin + most)
        while i > 0 and (text[i - 1] in " ▁" or i + 1 == len(text)):
            i = text.find(" ", i + 1)
        if i < 0:
            break
        parts.append(text[begin:i])
        begin = i + 1
    parts.append(text[begin:])
    return parts


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, in one pass without a shuffle.

    The tokenizer file (a few MB, read on the driver) travels with the job. Each Arrow batch of texts is cut into
    pieces at safe boundaries and dealt to calls of BATCH_BYTES; only the lengths return. Null texts count as empty:
    0 bytes, 0 tokens. A null id stays null; repeated rows and ids give a row each; other columns are not read. Texts
    of a tokenizer for which no boundary is proven safe are encoded whole.
    """
    text_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    kind = "json" if model_path.endswith(".json") else "model"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, splits = load(model, kind)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n_bytes, n_tokens = pc.binary_length(texts), [0] * len(texts)
            owners: list[int] = []
            pieces: list[str] = []
            held = 0

            def flush():
                for k, n in zip(owners, encode(pieces) if pieces else [], strict=True):
                    n_tokens[k] += n
                owners.clear()
                pieces.clear()

            for k, text in enumerate(texts.to_pylist()):
                for part in split_safely(text, PIECE_BYTES) if splits and len(text) > PIECE_BYTES else [text]:
                    owners.append(k)
                    pieces.append(part)
                    held += len(part)
                    if held >= BATCH_BYTES:
                        flush()
                        held = 0
            flush()
            held = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes.cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([n > limit for n in n_tokens])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
