"""Token ids of whole texts by a public tokenizer, by monoid tree reduction.

A text is halved until its parts are short, parts are encoded, and neighbours are joined up the
tree. Joining re-encodes a window at the seam that grows until the tokens outside it provably stay:

* The pre-tokenizer reads a text from left to right and forgets what it has read: from any place
  where a word of the whole text begins, the words that follow depend on the rest of the text only.
* Whether a word of the left part ends where it does depends on at most one character after it. So
  all words of the left part stay but the last, which touches the seam.
* The window begins with that last word and takes in more and more words of the right part. As soon
  as one of its word ends, other than its own end, falls on a word end of the right part, all words
  of the right part after that place stay, too. If the right part has no word left, the window is
  the rest of the text and there is nothing outside to prove.

Tokens never cross words, so ids outside the window stay. Joining is associative and the empty text
is its unit, hence a monoid; the result is that of encoding the whole text at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEAF_CHARS = 8192
_loaded: dict[str, object] = {}


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer: ``name`` itself if it is a path, else from the installed package."""
    if os.sep in name:
        return name
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def load(name: str):
    """The tokenizer, loaded once per worker; texts like its special tokens are ordinary text."""
    if name not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path(name))
        tokenizer.encode_special_tokens = True
        _loaded[name] = tokenizer
    return _loaded[name]


@dataclass
class Part:
    """An encoded stretch of text: ids word by word, and where each word ends, in characters."""

    text: str
    words: list[list[int]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def ids(self) -> list[int]:
        return [i for word in self.words for i in word]


def leaf(tokenizer, text: str) -> Part:
    """A stretch encoded at once."""
    part = Part(text)
    if text:
        encoding = tokenizer.encode(text, add_special_tokens=False)
        before = None
        for token, word, (_, end) in zip(encoding.ids, encoding.word_ids, encoding.offsets, strict=True):
            if word != before:
                part.words.append([])
                part.ends.append(end)
                before = word
            part.words[-1].append(token)
            part.ends[-1] = max(part.ends[-1], end)
    return part


def join(tokenizer, left: Part, right: Part) -> Part:
    """Two neighbouring stretches as one, by a window at the seam that grows until the outside is stable."""
    if not left.text:
        return right
    if not right.text:
        return left
    text = left.text + right.text
    seam = len(left.text)
    kept = len(left.words) - 1
    begin = left.ends[kept - 1] if kept > 0 else 0
    taken = 4
    while True:
        whole = taken >= len(right.words)
        window = leaf(tokenizer, text[begin:] if whole else text[begin : seam + right.ends[taken - 1]])
        if whole:
            words, ends, rest = window.words, window.ends, len(right.words)
            break
        places = {end: k for k, end in enumerate(right.ends[:taken])}
        # the window's own last words touch or look at its end: they prove nothing
        match = next(
            ((w, places[end + begin - seam]) for w, end in enumerate(window.ends[:-2]) if end + begin - seam in places), None
        )
        if match is not None:
            words, ends, rest = window.words[: match[0] + 1], window.ends[: match[0] + 1], match[1] + 1
            break
        taken *= 2
    return Part(
        text,
        left.words[: max(kept, 0)] + words + right.words[rest:],
        left.ends[: max(kept, 0)] + [begin + e for e in ends] + [seam + e for e in right.ends[rest:]],
    )


def encode_part(tokenizer, text: str, leaf_chars: int = LEAF_CHARS) -> Part:
    """A text of any length, by halves."""
    if len(text) <= leaf_chars:
        return leaf(tokenizer, text)
    middle = len(text) // 2
    return join(tokenizer, encode_part(tokenizer, text[:middle], leaf_chars), encode_part(tokenizer, text[middle:], leaf_chars))


def encode_texts(tokenizer, texts: list[str | None], leaf_chars: int = LEAF_CHARS) -> list[list[int]]:
    """The ids of each text; null and empty texts have none."""
    short = [i for i, t in enumerate(texts) if t and len(t) <= leaf_chars]
    out: list[list[int]] = [[] for _ in texts]
    for i, encoding in zip(short, tokenizer.encode_batch_fast([texts[i] for i in short], add_special_tokens=False), strict=True):
        out[i] = encoding.ids
    for i, text in enumerate(texts):
        if text and len(text) > leaf_chars:
            out[i] = encode_part(tokenizer, text, leaf_chars).ids()
    return out


def encode_corpus(
    df: DataFrame, text_col: str, out_col: str = "ids", tokenizer: str = "byte_bpe_50k.json", leaf_chars: int = LEAF_CHARS, count_only: bool = False
) -> DataFrame:
    """``df`` without ``text_col``, with the list of its token ids (``count_only``: their number, a bigint).

    Null, empty and blank texts: null and empty have the empty list (0), a blank one the ids of its
    blanks. Nothing is cut off, however long; texts are read batch by batch and nothing is shuffled.
    A column of ``df`` that has the name ``out_col`` is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (text_col, out_col)]
    kind = T.LongType() if count_only else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*kept, T.StructField(out_col, kind, False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                ids = encode_texts(own, piece.column(text_col).to_pylist(), leaf_chars)
                column = pa.array(map(len, ids), pa.int64()) if count_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(f.name) for f in kept), column], [*(f.name for f in kept), out_col])

    return df.select(*(f.name for f in kept), text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, ids_col: str, out_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """``df`` with the text of its token ids: the bytes of all tokens one after the other."""
    kept = [f for f in df.schema.fields if f.name not in (ids_col, out_col)]
    schema = T.StructType([*kept, T.StructField(out_col, T.StringType(), True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer)
        for batch in batches:
            texts = own.decode_batch([x or [] for x in batch.column(ids_col).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), out_col])

    return df.select(*(f.name for f in kept), ids_col).mapInArrow(run, schema)


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def p8_tokens_by_source(spark, sf_dir: str) -> DataFrame:
    """Tokens and documents of every collection."""
    counted = encode_corpus(table(spark, sf_dir, "documents").select("source", "text"), "text", "n", count_only=True)
    return counted.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"))


def p8_round_trip(spark, sf_dir: str) -> DataFrame:
    """Documents of every collection, and of how many the ids give the text again; encoded with small leaves, so that most texts are joined up a tree."""
    texts = table(spark, sf_dir, "documents").select("source", "text", F.coalesce("text", F.lit("")).alias("whole"))
    back = decode_corpus(encode_corpus(texts, "text", leaf_chars=128), "ids", "back")
    return back.groupBy("source").agg(F.count("*").alias("docs"), F.count(F.when(F.col("back") == F.col("whole"), 1)).alias("equal"))


QUERIES = {"p8_ids": p8_ids, "p8_tokens_by_source": p8_tokens_by_source, "p8_round_trip": p8_round_trip}
SQL = {"p8_round_trip": "SELECT source, count(*) AS docs, count(*) AS equal FROM documents GROUP BY source"}
