"""Byte-level BPE: encoding and decoding with the tokenizers library over Arrow batches.

Text is cut at the matches of a pattern; each match is encoded by a BPE model
of the tokenizers library whose characters stand for bytes.  Ids come back as
packed little-endian unsigned 32-bit integers, with the characters that each
token covers on request.  Decoding maps tokens to characters to bytes; a
character whose bytes are split over tokens comes out whole once its bytes
are joined.

Whole texts are encoded, piece after piece; a worker holds one Arrow batch
(cut to ``BATCH_CHARS`` characters at a time) and two caches of bounded size.
"""

from __future__ import annotations

import base64
import functools
import gc
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from talweg.llm._common import at, kept, pick, positional

#: Most entries in each of a worker's caches; the older half of a full cache goes.
CACHE = 400_000
#: New words encoded as one text.
JOINED = 200
#: Characters encoded before their rows are passed on.
BATCH_CHARS = 4_000_000
#: The pattern of the common byte-level vocabularies, for which spaces can be searched first: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space before a space, for Arrow; a character that is not white space before a space.
RUN = "[\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
_EDGE = re.compile(r"\S(?= )")


def _ends(parts: list[str]) -> np.ndarray:
    """Where each part ends in the bytes of their concatenation."""
    return np.cumsum([len(p) if p.isascii() else len(p.encode("utf-8", "surrogatepass")) for p in parts], dtype=np.int64)


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of tokens (bytes) from a rank file or from a tokenizer's JSON."""
    if path.endswith(".json"):
        back = {c: b for b, c in enumerate(byte_characters())}
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)
        special = {x["content"] for x in vocab["added_tokens"]}
        return {bytes(back[c] for c in t): i for t, i in vocab["model"]["vocab"].items() if t not in special}
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}


def read_added(path: str) -> dict[str, int]:
    """Added tokens of a tokenizer's JSON, with their ids; a rank file has none."""
    if not path.endswith(".json"):
        return {}
    with open(path, encoding="utf-8") as f:
        return {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}


class Codec:
    """Encoder and decoder of one vocabulary.

    With ``added`` (JSON vocabularies only) the strings of added tokens in a
    text become those tokens, as in the tokenizers library; otherwise they are
    ordinary text.  Any pattern will do; :data:`PATTERN` is encoded faster.
    Each of the two caches has up to ``most`` entries and those of one batch.
    """

    def __init__(self, path: str, pattern: str, added: bool = False, most: int | None = None):
        self.most = CACHE if most is None else most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        to_char = byte_characters()
        chars = ["".join(map(to_char.__getitem__, t)) for t in ranks]
        vocab = dict(zip(chars, ranks.values()))
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in json.load(f)["model"]["merges"]]
        else:  # any split of a token into two tokens is a merge of that token's rank
            merges = [(c[:i], c[i:]) for c in sorted(vocab, key=vocab.get) if len(c) > 1 for i in range(1, len(c)) if c[:i] in vocab and c[i:] in vocab]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=not path.endswith(".json"), cache_capacity=0))
        self.slow = pattern != PATTERN
        # For the common pattern the library cuts and maps bytes to characters itself.
        self.native = Tokenizer(self.model.model)
        self.native.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        from_char = {c: b for b, c in enumerate(to_char)}
        self.token_bytes = {i: bytes(map(from_char.__getitem__, c)) for c, i in vocab.items()}
        found = read_added(path) if added else {}
        self.token_bytes |= {i: t.encode() for t, i in found.items()}
        #: Packed id of each added token.
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in found.items()}
        self._apart = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if found else None
        self.token_size = np.zeros(max(self.token_bytes) + 1, np.int64)
        for i, t in self.token_bytes.items():
            self.token_size[i] = len(t)
        self.byte_start = np.cumsum(self.token_size) - self.token_size
        self.all_bytes = np.frombuffer(b"".join(self.token_bytes[i] for i in sorted(self.token_bytes)), np.uint8)
        self.to_chars = str.maketrans(dict(enumerate(to_char)))
        self.split = regex.compile(pattern).findall
        #: Ids of a space with the word behind it, by word, and of other matches.
        self.words: dict[str, bytes] = {}
        self.matches: dict[str, bytes] = {}

    def _stream(self, matches: list[str], text: str, ends: np.ndarray) -> list[bytes]:
        """Encode matches, each by itself, and cut their ids where ``ends`` (in bytes of ``text``, their concatenation) says."""
        chars = text.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        sizes = map(len, matches) if text.isascii() else (len(m.encode("utf-8", "surrogatepass")) for m in matches)
        stops = list(itertools.accumulate(sizes))
        cut = [chars[a:b] for a, b in zip([0, *stops], stops)]
        ids = [np.empty(0, "<u4")]
        for i in range(0, len(cut), 1000):
            e = self.model.encode_batch_fast([cut[i : i + 1000]], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(e.ids, "<u4"))
        whole = np.concatenate(ids)
        stop = (4 * (np.searchsorted(np.cumsum(self.token_size[whole]), ends, "left") + 1)).tolist()
        packed = whole.tobytes()
        return [packed[a:b] for a, b in zip([0, *stop], stop)]

    def _learn(self, words: set[str], matches: set[str]) -> None:
        """Put what is missing into the caches."""
        new = list(matches - self.matches.keys())
        if new:
            self.matches.update(zip(new, self._stream(new, "".join(new), _ends(new))))
        missing = words - self.words.keys()
        # Behind a word that ends in white space the next one would be cut otherwise.
        odd = [w for w in missing if not w or w[-1].isspace()]
        for w in odd:
            cut = self.split(" " + w)
            self.words[w] = b"".join(self._stream(cut, " " + w, _ends(cut)))
        plain = list(missing.difference(odd))
        if plain and self.slow:
            text = " " + " ".join(plain)
            self.words.update(zip(plain, self._stream(self.split(text), text, _ends(plain) + np.arange(1, len(plain) + 1))))
        elif plain:
            joined = [" " + " ".join(plain[i : i + JOINED]) for i in range(0, len(plain), JOINED)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.native.encode_batch_fast(joined, add_special_tokens=False)])
            ends = np.cumsum(pc.binary_length(pa.array(plain, pa.large_string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            stop = (4 * (np.searchsorted(np.cumsum(self.token_size[ids]), ends, "left") + 1)).tolist()
            packed = ids.tobytes()
            self.words.update(zip(plain, [packed[a:b] for a, b in zip([0, *stop], stop)]))

    def _chunks(self, text: str) -> list[str]:
        """Cut a very long text where a match must begin: at a space behind a character that is not white space."""
        out, start = [], 0
        while not self.slow and len(text) - start > BATCH_CHARS:
            found = _EDGE.search(text, start + BATCH_CHARS)
            if not found:
                break
            out.append(text[start : found.end()])
            start = found.end()
        return [*out, text[start:]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        packed, stops = ids.tobytes(), (4 * ends).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids end.  Null counts as empty."""
        gc.disable()  # many small objects and no cycles
        try:
            texts = pc.fill_null(texts, "")
            cut, owner = self._cut(texts)
            if cut is None:
                return self._encode(texts)
            own = [self._part(x) for x in cut]
            ids = np.concatenate([np.empty(0, "<u4"), *(i for i, _ in own)])
            sizes = np.concatenate([np.empty(0, np.int64), *(np.diff(e, prepend=0) for _, e in own)])
            return ids, np.cumsum(np.bincount(owner, sizes, len(texts)).astype(np.int64))
        finally:
            gc.enable()

    def _part(self, x: str | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not isinstance(x, str):
            return self._encode(x)
        if x in self.added:
            return np.frombuffer(self.added[x], "<u4"), np.ones(1, np.int64)
        return self._encode(pa.array([x], pa.large_string()))

    def _cut(self, texts: pa.Array) -> tuple[list | None, np.ndarray]:
        """Parts with the text that each piece belongs to: very long texts in chunks, added tokens apart; None if there is nothing to cut."""
        found = pc.greater(pc.binary_length(texts), BATCH_CHARS)
        if self.added:
            found = pc.or_(found, pc.match_substring_regex(texts, "|".join(map(re.escape, self.added))))
        odd = np.flatnonzero(found.to_numpy(zero_copy_only=False))
        if not len(odd):
            return None, odd
        parts: list = []
        owner: list[int] = []
        done = 0
        for i in odd.tolist():
            if i > done:
                parts.append(texts.slice(done, i - done))
                owner += range(done, i)
            for chunk in self._apart.split(texts[i].as_py()) if self.added else [texts[i].as_py()]:
                for x in [chunk] if chunk in self.added else self._chunks(chunk):
                    parts.append(x)
                    owner.append(i)
            done = i + 1
        if done < len(texts):
            parts.append(texts.slice(done))
            owner += range(done, len(texts))
        return parts, np.array(owner, np.int64)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode_column: each distinct word of the batch is looked up once, and Arrow and numpy put the ids together."""
        for cache in (self.words, self.matches):
            if len(cache) > self.most:
                for old in list(itertools.islice(cache, len(cache) // 2)):
                    del cache[old]
        n = len(texts)
        # Without white space before a space, each space begins a match; other texts are cut by the pattern.
        plain = np.zeros(n, bool) if self.slow else ~pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        flat, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        head = np.zeros(len(flat), bool)
        head[np.cumsum(sizes) - sizes] = True
        coded = flat.filter(pa.array(~head)).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = [self.split(x) for x in flat.filter(pa.array(head)).to_pylist()]
        others = [self.split(x) for x in texts.filter(pa.array(~plain)).to_pylist()]
        self._learn(set(words), {m for x in (*heads, *others) for m in x})
        word, match = self.words.__getitem__, self.matches.__getitem__
        entries = [*map(word, words), *(b"".join(map(match, x)) for x in heads), *(b"".join(map(match, x)) for x in others)]
        # Codes of all texts in order: the head and the words of plain texts, one entry for any other.
        codes = np.empty(len(flat), np.int64)
        codes[~head] = coded.indices.to_numpy(zero_copy_only=False)
        codes[head] = len(words) + np.arange(len(heads))
        counts = np.ones(n, np.int64)
        counts[plain] = sizes
        whole = np.empty(counts.sum(), np.int64)
        at = np.repeat(plain, counts)
        whole[at], whole[~at] = codes, len(words) + len(heads) + np.arange(len(others))
        length = np.array([len(x) // 4 for x in entries], np.int64)
        start = np.cumsum(length) - length
        own = length[whole]
        ends = np.cumsum(own)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(start[whole] - (ends - own), own) + np.arange(total)
        stops = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.frombuffer(b"".join(entries), "<u4")[index], stops.astype(np.int64)

    def offsets(self, text: str, ids: bytes) -> list[tuple[int, int]]:
        """The characters (start, end) that each token covers; tokens that share a split character all cover it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        ends = np.cumsum([len(self.token_bytes[i]) for i in np.frombuffer(ids, "<u4").tolist()], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        return list(zip(char[starts].tolist(), (char[ends - 1] + 1).tolist()))

    def decode_bytes(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_column(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and where the bytes of each row end; ``ends`` as in encode_column."""
        own = self.token_size[ids]
        stops = np.concatenate([[0], np.cumsum(own)])
        index = np.repeat(self.byte_start[ids] - stops[:-1], own) + np.arange(stops[-1])
        return self.all_bytes[index], stops[ends]

    def decode(self, ids: bytes) -> str:
        """Text; bytes that are no whole character (cut token sequences) become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@kept
@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str, added: bool = False, most: int | None = None) -> Codec:
    """One codec for each worker process."""
    return Codec(path, pattern, added, most)


def packed_rows(ids: np.ndarray, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Binary rows of the items up to each end."""
    raw = np.ascontiguousarray(ids)
    edges = np.concatenate([[0], ends]) * raw.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(raw)]).cast(kind or pa.binary())


def slices(batch: pa.RecordBatch, text: str = "text", most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds about ``most`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if not len(column):
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + most, "right")))
        yield batch.slice(start, end - start)
        start = end


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``id, text, ids`` (packed), with ``offsets`` (array of start, end) on request.

    Null texts count as empty and have no ids.  Rows come out one for one,
    repeated rows and null ids included; other columns are ignored.  An empty
    table gives an empty result.
    """
    rows = pick(df, id=id_col, text=text_col)

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                texts = pc.fill_null(batch.column(1), "")
                ids = packed_rows(*own.encode_column(texts))
                columns = [batch.column(0), texts, ids]
                if offsets:
                    spans = [[{"start": a, "end": b} for a, b in own.offsets(t, i)] for t, i in zip(texts.to_pylist(), ids.to_pylist())]
                    columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
                yield pa.RecordBatch.from_arrays(columns, ["id", "text", "ids", "offsets"][: len(columns)])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string, ids binary" + ", offsets array<struct<start:int,end:int>>" * offsets)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``df`` and, last, the decoded bytes of its packed ids.

    Null ids and ids of no tokens decode to no bytes; an empty table gives an
    empty result.  A column of the caller that is called ``out`` already stays,
    so that there are two of that name.  An id of no token raises KeyError.
    """
    rows, at_ids = positional(df), at(df, ids_col)
    schema = StructType([*rows.schema.fields, StructField("out", BinaryType())])

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole, at_ids):
                raw = [own.decode_bytes(x or b"") for x in batch.column(batch.schema.get_field_index(at_ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], schema.names)

    return rows.mapInArrow(run, schema).toDF(*df.columns, out)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids, decoded``: encode and decode in one pass, without the text in between; nulls as in :func:`encode`."""
    rows = pick(df, id=id_col, text=text_col)

    def run(batches):
        own = codec(path, pattern)
        for whole in batches:
            for batch in slices(whole):
                ids, ends = own.encode_column(batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), packed_rows(ids, ends), packed_rows(*own.decode_column(ids, ends))], ["id", "ids", "decoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded binary")
