"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last eight bytes has its low bits zero, so equal passages
of different documents are cut alike whatever stands around them. A chunk keeps its whole words, those
between its first and its last ASCII white space; they are encoded once and reused from a bounded
cache. Chunks are joined by repair: what stands around a cut, together with a whole word that is
already encoded on either side, is encoded anew by the library, and the join holds if these ids begin
and end with the ids of the two known words. Where they don't agree, the repair grows to the whole
text. Chunks without a whole word are taken into the repair.

This holds for tokenizers whose pieces never contain white space and whose tokens have no decoder, as
the file says itself (see splits_at_space). The texts of any other tokenizer go through the library
whole, both ways.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import has_caches, map_arrow, read_table

#: File of the tokenizer where no path is given.
TOKENIZER = "word_bpe_49k.json"
#: A cut where the rolling hash has these bits zero: 256 bytes on average.
CUT_MASK = np.uint32(255)
#: Entries and bytes that the caches of one Python worker may hold.
WORD_ENTRIES, REPAIR_ENTRIES, CHUNK_BYTES = 300_000, 20_000, 32_000_000
#: Words whose ids are put together at a time.
GATHER_WORDS = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)
#: Words of these characters are cut into pieces here; all others go through the library's own normaliser and splitter.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile(r"[a-zà-öø-ÿß]+|[0-9]|[^a-zà-öø-ÿß0-9]+")
#: The pieces with blanks around them that leave the others standing between blanks, too.
_SET_APART = r"([a-zà-öø-ÿß]+|[0-9])"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def splits_at_space(spec: dict) -> bool:
    """Whether a tokenizer file says that pieces never contain white space and that tokens decode with blanks between.

    White space goes before splitting or is dropped by it: a Replace of runs of it by a blank and no
    normaliser that joins across blanks, then a Split that keeps matches of a pattern only, none of
    whose alternatives takes in white space. No special tokens with blanks, and no decoder.
    """

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if not part else part[name] if part["type"] == "Sequence" else [part]

    normal, cut = steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers")
    if any(x["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace") for x in normal) or any(x["type"] == "Replace" and x.get("pattern") != {"Regex": "\\s+"} for x in normal):
        return False
    if not cut or cut[0]["type"] != "Split" or cut[0]["behavior"] != "Removed" or not cut[0]["invert"]:
        return False
    safe = all(re.fullmatch(r"'[a-z]+|\[?\\p\{[LN]\}\]?\+?|\[\^\\s\\p\{L\}\\p\{N\}\]\+", x) for x in cut[0]["pattern"].get("Regex", " ").split("|"))
    rest = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in cut[1:])
    return safe and rest and not spec.get("decoder") and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", ()))


class Generations(dict):
    """A cache that makes what it lacks, in two generations: at the limit the young entries become old and the old ones go."""

    def __init__(self, entries: int, make):
        super().__init__()
        self.entries, self.make, self.old = entries, make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """The tokenizer of a file, with caches. encode() gives ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.pieces = Generations(WORD_ENTRIES, self._piece)
        self.words = Generations(WORD_ENTRIES, self._word)
        self.word = self.words.__getitem__
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.by_words = splits_at_space(spec)
        self.plain = self.by_words and bool(self.model) and self._same_pieces()
        self.repairs = Generations(REPAIR_ENTRIES, lambda span: self._library(span.decode("utf-8", "surrogatepass")))
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0
        size = self.tokenizer.get_vocab_size()
        self.tokens = [self.tokenizer.id_to_token(i) for i in range(size)]

    def _library(self, text: str) -> bytes:
        return _bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _same_pieces(self) -> bool:
        """Whether the short way of encoding plain words gives what the library gives, on probes of each kind."""
        probes = ["Word", "WÖRD12x", "a.b,c!!", "the***", "x$$$y%%%", "é", "ÀÉÎß", "99", "a1b2", "==", "<x>", "don", "&&&", "ñandú-ü;", "ÿÿ", "A" * 40]
        self.plain = True
        return all(self._pieces(p) == self._library(p) == self._table(pa.array([p]))[0].tobytes() for p in probes if _PLAIN.fullmatch(p))

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join(map(_byte_char, piece.encode()))
        return _bytes_of([t.id for t in self.model.tokenize(mapped)])

    def _pieces(self, word: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word.lower())))

    def _word(self, word: bytes) -> bytes:
        """The ids of a run of bytes without ASCII white space."""
        if self.plain:
            if word.isalpha():  # ASCII letters: a single piece
                return self.pieces[word.lower().decode()]
            text = word.decode("utf-8", "surrogatepass")
            if _PLAIN.fullmatch(text):
                low = text.lower()
                if low.isalpha():
                    return self.pieces[low]
                if low[:-1].isalpha() and not low[-1].isdigit():
                    return self.pieces[low[:-1]] + self.pieces[low[-1]]
                return self._pieces(text)
            return self._library(text)
        return self._library(word.decode("utf-8", "surrogatepass"))

    def span(self, span: bytes) -> bytes:
        """The ids of bytes that begin and end at white space, or at an end of the text."""
        return b"".join(map(self.word, span.split())) if self.by_words else self._library(span.decode("utf-8", "surrogatepass"))

    def spans(self, texts: pa.Array, end: int) -> tuple[Iterator[np.ndarray], np.ndarray]:
        """The ids of whole texts, each followed by end, in pieces one after the other; and the number of ids of each text, end included.

        Each different word of the texts is looked up once, and its ids are put wherever it stands.
        """
        if not self.by_words:
            ids = [np.frombuffer(self._library(t or ""), "<u4") for t in texts.to_pylist()]
            return (np.append(x, np.uint32(end)) for x in ids), np.array([len(x) + 1 for x in ids], np.int64)
        words = pc.ascii_split_whitespace(texts)
        n_words = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        flat, starts, size = self._table(coded.dictionary)
        # the last entry is the end of a text
        flat, starts, size = np.append(flat, np.uint32(end)), np.append(starts, len(flat)), np.append(size, 1)
        ends = np.cumsum(n_words)
        number = np.insert(coded.indices.to_numpy(), ends, len(size) - 1)
        pieces = (_taken(flat, starts, size, number[at : at + GATHER_WORDS]) for at in range(0, len(number), GATHER_WORDS))
        upto = np.concatenate([[0], np.cumsum(size[number])])
        return pieces, np.diff(upto[ends + np.arange(1, len(ends) + 1)], prepend=0)

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of different words one after the other, where each word's begin, and how many it has."""
        if not self.plain:
            return _joined(map(self.word, words.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()))
        plain = pc.match_substring_regex(words, f"^{_PLAIN.pattern}$")
        spaced = pc.replace_substring_regex(pc.utf8_lower(words), pattern=_SET_APART, replacement=r" \1 ")
        pieces = pc.ascii_split_whitespace(pc.if_else(plain, spaced, ""))
        coded = pieces.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        table = _joined(map(self.pieces.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()))
        flat = _taken(*table, number)
        upto = np.concatenate([[0], np.cumsum(table[2][number])])
        size = np.diff(upto[np.cumsum(pc.list_value_length(pieces).to_numpy())], prepend=0)
        starts = np.cumsum(size) - size
        other = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if len(other):
            more, at, n = _joined(map(self.word, words.take(pa.array(other)).cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()))
            starts[other], size[other] = len(flat) + at, n
            flat = np.concatenate([flat, more])
        return flat, starts, size

    def chunk(self, chunk: bytes) -> tuple | None:
        """(bytes up to the end of its first whole word, ids of that word, ids of all whole words, bytes from the last whole word on, ids of that word), or None without a whole word."""
        got = self.chunks.get(chunk, 0)
        if got == 0:
            words = chunk.split()
            # the first and the last run of bytes may go on beyond the cut
            whole = words[not chunk[:1].isspace() : len(words) - (not chunk[-1:].isspace())]
            got = None
            if whole:
                ids = list(map(self.word, whole))
                first = chunk.index(whole[0], 0 if chunk[:1].isspace() else len(words[0])) + len(whole[0])
                last = chunk.rindex(whole[-1], 0, len(chunk) if chunk[-1:].isspace() else len(chunk) - len(words[-1]))
                got = (chunk[:first], ids[0], b"".join(ids), chunk[last:], ids[-1])
            cost = 6 * len(chunk) + 700
            if self.chunk_bytes + cost > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = 0
            self.chunks[chunk] = got
            self.chunk_bytes += cost
        return got

    def document(self, chunks: Iterable[bytes]) -> bytes | None:
        """Chunks of one text, joined; None where a repair doesn't agree with the words on both sides."""
        out, pending, known = [], b"", b""
        for c in chunks:
            found = self.chunk(c)
            if found is None:
                pending += c
                continue
            head, first, core, tail, last = found
            repaired = self.repairs[pending + head]
            if not (repaired.startswith(known) and repaired.endswith(first) and len(repaired) >= len(known) + len(first)):
                return None
            out.append(repaired[len(known) : len(repaired) - len(first)])
            out.append(core)
            pending, known = tail, last
        repaired = self.repairs[pending]
        if not repaired.startswith(known):
            return None
        out.append(repaired[len(known) :])
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_words:
            return [self._library(t or "") for t in texts]
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        return [self._library(t or "") if ids is None else ids for t, ids in zip(texts, map(self.document, cut(raw)))]

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False); for a tokenizer without a decoder that is its tokens with blanks between."""
        numbers = memoryview(ids).cast("I") if ids else ()
        if not self.by_words:
            return self.tokenizer.decode(list(numbers), skip_special_tokens=False)
        tokens = self.tokens
        return " ".join([tokens[i] for i in numbers])


def _bytes_of(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


def _joined(ids: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ids one after the other, where each begins, and how many ids it has."""
    runs = list(ids)
    size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
    return np.frombuffer(b"".join(runs), "<u4"), np.cumsum(size) - size, size


def _taken(flat: np.ndarray, starts: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    """The runs with these numbers one after the other."""
    sizes = size[number]
    upto = np.cumsum(sizes)
    return flat[np.repeat(starts[number] - (upto - sizes), sizes) + np.arange(sizes.sum())]


def _byte_char(b: int) -> str:
    """The printable character that byte-level tokenizers use for a byte."""
    return _BYTE_CHARS[b]


def _byte_chars() -> list[str]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


_BYTE_CHARS = _byte_chars()


def cut(texts: list[bytes]) -> list[list[bytes]]:
    """Each text's chunks. Windows that begin before the text never cut it, so cuts depend on the text alone."""
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    if not len(buffer):
        return [[] for _ in texts]
    gear = _GEAR[buffer]
    rolling = gear.copy()
    for k in range(1, 8):
        rolling[k:] += gear[:-k] << np.uint32(k)
    at = np.flatnonzero((rolling & CUT_MASK) == 0) + 1
    at = at[at < len(buffer)]
    at = at[(buffer[at] & 0xC0) != 0x80]
    ends = np.cumsum([len(t) for t in texts])
    of = np.searchsorted(ends, at, side="right")
    starts = ends - np.array([len(t) for t in texts])
    ok = at - starts[of] >= 8
    at, of = at[ok], of[ok]
    inside = (at - starts[of]).tolist()
    bounds = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
    out = []
    for k, text in enumerate(texts):
        cuts = [0, *inside[bounds[k] : bounds[k + 1]], len(text)]
        out.append([text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a])
    return out


_ENCODERS: dict[str, Encoder] = {}
has_caches(__name__, _ENCODERS.clear)


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for a tokenizer file; caches live as long as the worker."""
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def bpe_encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, decode: bool = True) -> DataFrame:
    """Whole texts to token ids and back.

    Returns (doc_id, n_tokens long, ids binary [, decoded string]): ids are little-endian unsigned
    32-bit integers; decoded is the text that the library's decode gives for them. One row for each
    input row, also for repeated ones and for null ids. Null and empty texts have no ids and decode
    to the empty text. Texts of any length are encoded whole. Other columns of docs are not read, so
    their names can't clash. An empty table gives no rows. tokenizer is the file's path on the
    executors, of any kind the library reads; None is the public word-level BPE.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = dict(docs.dtypes)["doc_id"]

    def of(batch: pa.RecordBatch):
        enc = encoder(tokenizer)
        doc_ids, texts = batch.column(0), batch.column(1)
        start = 0
        while start < len(texts):  # a part of the batch at a time
            part = texts.slice(start, 128).to_pylist()
            ids = enc.encode(part)
            columns = [doc_ids.slice(start, len(part)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array([enc.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
            start += len(part)

    return map_arrow(docs, of, f"doc_id {id_type}, n_tokens long, ids binary" + ", decoded string" * decode)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    found = bpe_encode_decode(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
