"""Byte-pair encoding of whole texts over tables of distinct words, and back."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import as_bytes, fresh

TABLE_WORDS = 400_000  # distinct words that a task holds at once
BATCH_WORDS = 250_000  # words of the texts that it works on at once
ENCODED_AT_ONCE = 2_000

# Characters of which every Unicode version says the same class; texts with
# others are split into words by the tokenizer library itself.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-ɏ]*")
# The word pattern that the vocabulary was made with (fixed value), in which
# the letters, numbers and blanks are those of the plain characters.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\r "
_PATTERN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+"
                      f"|[{_S}]+(?![^{_S}])|[{_S}]+")


class WordTable:
    """Distinct words, each encoded once: a number for each word, and the ids
    of word k at ``ids[at[k]:at[k + 1]]``."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        file = json.loads(vocabulary)
        self.special = [t["content"] for t in file["added_tokens"]]
        self.fast = self._by_rank(file)
        self.clear()

    def _by_rank(self, file: dict):
        """An encoder that merges by id, four times as fast. Ids in the order
        of the merges give the same result; of other vocabularies, None."""
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        parts = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if [vocab.get("".join(m)) for m in parts] != list(range(256, 256 + len(parts))):
            return None
        import tiktoken
        ranks = {p: i for i, p in enumerate(_pieces(file)[:256 + len(parts)])}
        return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list:
        if self.fast is None:
            return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return [self.tokenizer.encode(w, add_special_tokens=False).ids
                if any(x in w for x in self.special) else self.fast.encode_ordinary(w) for w in words]

    def clear(self):
        self.number, self.ids, self.at = {}, np.empty(0, np.int32), np.zeros(1, np.int64)

    def split(self, text: str) -> list:
        """Words whose ids in turn are the ids of the text. A text that holds a
        special token is one word, which the library encodes as a whole."""
        if any(s in text for s in self.special):
            return [text]
        if _PLAIN.fullmatch(text):
            return _PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def numbers(self, words: list) -> np.ndarray:
        if len(self.number) > TABLE_WORDS:
            self.clear()
        new = list(set(words) - self.number.keys())
        if new:
            n, ids, sizes = len(self.number), [self.ids], []
            for i in range(0, len(new), ENCODED_AT_ONCE):  # what the library returns is large
                found = self.encode(new[i:i + ENCODED_AT_ONCE])
                size = list(map(len, found))
                ids.append(np.fromiter(chain.from_iterable(found), np.int32, sum(size)))
                sizes += size
            self.number.update(zip(new, range(n, n + len(new))))
            self.ids = np.concatenate(ids)
            self.at = np.concatenate((self.at, self.at[-1] + np.cumsum(sizes)))
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))


def gather(values: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``which`` of a ragged array, end to end, and the size of each."""
    sizes = at[which + 1] - at[which]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(at[which] - (ends - sizes), sizes)], sizes


def _parts(texts: list):
    """Runs of texts of up to about BATCH_WORDS words, or of one text."""
    begin = held = 0
    for i, t in enumerate(texts):
        size = len(t) // 4 if t else 0
        if held and held + size > BATCH_WORDS:
            yield begin, i
            begin, held = i, 0
        held += size
    yield begin, len(texts)


def _encoder(sent, n: int, names: list[str]):
    """Batches of n columns and a text -> the columns and ``token_ids``."""
    def run(batches):
        table = WordTable(sent.value)
        for b in batches:
            texts = as_bytes(b.column(n))
            for begin, end in _parts(texts):
                words, counts = [], []
                for t in texts[begin:end]:
                    found = table.split(t.decode()) if t else []
                    words += found
                    counts.append(len(found))
                which = table.numbers(words)  # may lengthen the table
                ids, sizes = gather(table.ids, table.at, which)
                ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *counts])]
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(i).slice(begin, end - begin) for i in range(n)] + [column],
                    names=[*names[:n], "token_ids"])

    return run


def _source(df: DataFrame, keep: list[str], column: str) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias(fresh(df, "_src")))


_IDS = T.StructField("token_ids", T.ArrayType(T.IntegerType()))
_DECODED = T.StructField("decoded", T.StringType())


def _sent_text(spark, vocabulary_path: str):
    with open(vocabulary_path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text",
           keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``token_ids``, the ids of the whole text.

    Each task splits its texts into words, holds a table of the distinct ones,
    encodes every new word once, and puts the ids back by the words' positions;
    a table that has grown past TABLE_WORDS starts anew. The ids are those of
    the tokenizer library on the whole text without added special tokens; a
    special token's string in a text has its id. Null and empty texts have no
    ids. A column named ``token_ids`` is replaced. Nothing is shuffled.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "token_ids"]
    run = _encoder(_sent_text(docs.sparkSession, vocabulary_path), len(keep), keep)
    return _source(docs, keep, text).mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + [_IDS]))


def pieces(vocabulary_path: str) -> list[bytes]:
    """The bytes of every token id of a byte-level vocabulary.

    Vocabulary files write a byte as a printable character: printable Latin-1
    bytes as themselves, the others as the characters from 256 on, in order.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        return _pieces(json.load(f))


def _pieces(file: dict) -> list[bytes]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain}
    byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    by_id = {i: bytes(byte_of[c] for c in piece) for piece, i in file["model"]["vocab"].items()}
    by_id |= {t["id"]: t["content"].encode() for t in file["added_tokens"]}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def _decoder(sent, n: int, ids_stay: bool):
    """Batches of n columns and ids -> the columns, the ids if they are to
    stay, and ``decoded``."""
    def run(batches):
        flat, at = sent.value
        for b in batches:
            column, out = b.column(n), []
            for i in range(b.num_rows):
                row = column[i].values
                which = row.to_numpy(zero_copy_only=False) if row is not None else np.empty(0, np.int64)
                out.append(gather(flat, at, which)[0].tobytes().decode("utf-8", "replace"))
            stay = n + ids_stay
            yield pa.RecordBatch.from_arrays(
                [b.column(i) for i in range(stay)] + [pa.array(out, pa.string())],
                names=[*b.schema.names[:stay], "decoded"])

    return run


def _sent_pieces(spark, vocabulary_path: str):
    table = pieces(vocabulary_path)
    return spark.sparkContext.broadcast((np.frombuffer(b"".join(table), np.uint8),
                                         np.concatenate(([0], np.cumsum([len(p) for p in table])))))


def decode(tokens: DataFrame, vocabulary_path: str, ids: str = "token_ids",
           keep: list[str] | None = None) -> DataFrame:
    """``tokens`` with ``decoded``, the text of the ids.

    The table of pieces, one row for each id of the vocabulary and so bounded
    by it, is sent to all tasks and joined to the ids by position; bytes that
    are no UTF-8 become replacement characters. Null or no ids give an empty
    text. A column named ``decoded`` is replaced.
    """
    keep = [c for c in (keep if keep is not None else tokens.columns) if c != "decoded"]
    run = _decoder(_sent_pieces(tokens.sparkSession, vocabulary_path), len(keep), False)
    return _source(tokens, keep, ids).mapInArrow(run, T.StructType([tokens.schema[c] for c in keep] + [_DECODED]))


def digests(docs: DataFrame, vocabulary_path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    ``encode`` and ``decode`` in one pass over the batches of a task.
    """
    spark, n = docs.sparkSession, len(keep)
    encoder = _encoder(_sent_text(spark, vocabulary_path), n, keep)
    decoder = _decoder(_sent_pieces(spark, vocabulary_path), n, True)
    both = _source(docs, keep, text).mapInArrow(
        lambda batches: decoder(encoder(batches)),
        T.StructType([docs.schema[c] for c in keep] + [_IDS, _DECODED]))
    return both.select(
        *keep, F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
