"""BPE encoding and decoding with the public tokenizer files.

Texts split into pieces by the file's own pattern, and a piece's ids depend on the piece alone. Runs of
pieces between white spaces are remembered in a worker, so each distinct one meets the library once. A long piece that the pattern
does not split (a run of letters without spaces, say) is encoded by tree concatenation:

* the piece is cut into leaves and all leaves are encoded at once (the library uses a thread for each),
* two neighbours are joined by encoding a window of tokens around the seam anew,
* the window grows until both its edges agree with the tokens outside it.

Two tokens agree when their joined bytes encode to just these two. A sequence in which all neighbours
agree is the encoding of the whole: the first merge across a border would also happen between the two
tokens alone. So the result is exact, not approximate.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from moltabula.llm.common import arrow_map, id_and_text, slices

LEAF = 2048  # characters of a leaf of the tree
WINDOW = 8  # tokens on each side of a seam at first
REMEMBERED = 400_000  # chunks remembered in a worker
SLICE = 4 << 20  # bytes of text that are encoded together
GROUP = 256  # short pieces in one call of the library

# Characters whose class and case are the same in every Unicode version; texts with others go to the library whole.
_BYTE_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-¬®-ſЀ-џ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]*")
_WORD_PLAIN = regex.compile(r"[\t\n\r\x20-\x7eÀ-ÿЀ-џ‐-‧一-龥가-힣]*")
# The split patterns of the two files (fixed values).
_BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_CHUNK = re.compile(r"\s*\S+|\s+")
_SPACE = frozenset(" \n\t\r")
_PAIRS = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
# Marks between a letter and white space are a piece of their own, so words are remembered without them.
_CLOSED = r"(\pL)([.,;:!?]+)(\s|$)"


def _padded(text: str) -> bool:
    """White space other than single spaces and line breaks between words, in a text that has no other kinds of it than these, tabs and returns."""
    return text[:1] in _SPACE or text[-1:] in _SPACE or any(p in text for p in _PAIRS)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return [table[b] for b in range(256)]


class Bpe:
    """Encoder and decoder for one tokenizer file; equal to the library on every text."""

    def __init__(self, path: str, leaf: int = LEAF, window: int = WINDOW):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.words = bool(self.suffix)
        self.special = [t["content"] for t in spec["added_tokens"]]
        bare = dict(spec, normalizer=None, pre_tokenizer=None, post_processor=None, decoder=None, added_tokens=[])
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.apart = Tokenizer.from_str(json.dumps(dict(bare, pre_tokenizer={"type": "WhitespaceSplit"})))
        self.alphabet = byte_alphabet()
        self.plain, self.split = (_WORD_PLAIN, _WORD_SPLIT) if self.words else (_BYTE_PLAIN, _BYTE_SPLIT)
        self.leaf, self.window = leaf, window
        self.known: dict[str, bytes] = {}  # by chunk as it stands in the text
        self.mapped: dict[str, bytes] = {}  # by piece in the byte alphabet, which may look like another chunk
        back = {c: b for b, c in enumerate(self.alphabet)}
        self.vocab_size = self.library.get_vocab_size(with_added_tokens=True)
        self.token_bytes: list[bytes] = [b""] * self.vocab_size
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            if token in self.special:
                self.token_bytes[i] = token.encode()
            else:
                body = token.removesuffix(self.suffix) if self.words else token
                self.token_bytes[i] = bytes(back[c] for c in body)
        self.decimal = [str(i) for i in range(self.vocab_size)]
        self.token_chars = [""] * self.vocab_size
        for token, i in self.library.get_vocab(with_added_tokens=False).items():
            self.token_chars[i] = token

    # -- one piece ---------------------------------------------------------------------------

    def _mapped(self, piece: str) -> str:
        table = self.alphabet
        return "".join([table[b] for b in piece.encode()])

    def _bare_ids(self, mapped: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(mapped, add_special_tokens=False)]

    def _agree(self, a: int, b: int) -> bool:
        return self._bare_ids([self.token_chars[a] + self.token_chars[b]])[0] == [a, b]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        width = self.window
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            middle = self._bare_ids(["".join([self.token_chars[t] for t in left[a:] + right[:b]])])[0]
            if (a == 0 or self._agree(left[a - 1], middle[0])) and (b == len(right) or self._agree(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def tree(self, mapped: str) -> list[int]:
        """Ids of an unsplit piece, in the byte alphabet, by tree concatenation.

        Not for files with word ends: there the last characters of a word encode in their own way.
        """
        leaves = [mapped[i:i + self.leaf] for i in range(0, len(mapped), self.leaf)]
        level = self._bare_ids(leaves)
        while len(level) > 1:
            joined = [self._join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2:]
        return level[0] if level else []

    def _many(self, mapped: list[str]) -> list[bytes]:
        """Ids of pieces in the byte alphabet; side by side in one string they cost the library less than alone."""
        out: list[bytes] = []
        groups = [mapped[i:i + GROUP] for i in range(0, len(mapped), GROUP)]
        for group, found in zip(groups, self.apart.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32).tobytes()
            cuts = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(group) + 1))).tolist()
            out += [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _pieces(self, chunk: str) -> list[str]:
        # a run of letters, with one space before it in a byte-level file, is one piece of either pattern
        if chunk.isalpha() or (not self.words and chunk[:1] == " " and chunk[1:].isalpha()):
            return [chunk]
        return self.split.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks, each a run of pieces between two white spaces."""
        pieces = [self._pieces(c) for c in chunks]
        new = list(set().union(*pieces)) if pieces else []
        short = [p for p in new if self.words or len(p) * 4 <= self.leaf]
        ids = dict(zip(short, self._many([p if p.isascii() and p.isalpha() else self._mapped(p) for p in short])))
        if len(short) < len(new):
            ids.update({p: np.array(self.tree(self._mapped(p)), np.uint32).tobytes() for p in set(new).difference(short)})
        self.known.update({c: ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts]) for c, parts in zip(chunks, pieces)})

    # -- whole texts -------------------------------------------------------------------------

    def _is_plain(self, text: str) -> bool:
        """Whether a text may be cut into chunks here; others the library has to split."""
        return self.plain.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _chunks(self, texts: list[str]) -> pa.ListArray:
        """Chunks that encode on their own.

        A piece never goes on across white space after another character, so a text falls into chunks of
        leading white space and what follows.
        """
        if self.words:
            column = pc.replace_substring_regex(pc.utf8_lower(pa.array(texts, pa.string())), _CLOSED, r"\1 \2\3")
            return pc.utf8_split_whitespace(column)
        padded = [i for i, t in enumerate(texts) if _padded(t)]
        column = pc.replace_substring_regex(pa.array(texts, pa.string()), _CLOSED, "\\1\0\\2\\3")
        for mark in " \n":
            column = pc.replace_substring(column, mark, f"\0{mark}")
        if not padded:
            return pc.split_pattern(column, "\0")
        # repeated white space belongs to one chunk; such texts are cut here, the others by the library of arrays
        cut = pa.array([_CHUNK.findall(texts[i]) for i in padded], pa.list_(pa.string()))
        where = np.arange(len(texts))
        where[padded] = len(texts) + np.arange(len(padded))
        return pa.concat_arrays([pc.split_pattern(column, "\0"), cut]).take(pa.array(where))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        for memory in (self.known, self.mapped):
            if len(memory) > REMEMBERED:
                for key in list(itertools.islice(memory, len(memory) // 2)):
                    del memory[key]
        plain = [i for i, t in enumerate(texts) if self._is_plain(t)]
        out = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._library_or_parts(texts[i])
        if plain:
            for i, ids in zip(plain, self._encode_plain([texts[i] for i in plain])):
                out[i] = ids
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        """Each distinct chunk of the texts is looked up once, and ids are gathered by position."""
        chunks = self._chunks(texts)
        codes = chunks.flatten().dictionary_encode()
        distinct = codes.dictionary.to_pylist()
        found = list(map(self.known.get, distinct))
        missing = [i for i, f in enumerate(found) if f is None]
        self._learn([distinct[i] for i in missing])
        for i in missing:
            found[i] = self.known[distinct[i]]
        table = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = codes.indices.to_numpy()
        starts, lengths = (np.cumsum(sizes) - sizes)[at], sizes[at]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        ids = table[np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1])]
        edges = ends[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(edges, edges[1:])]

    def _library_or_parts(self, text: str) -> bytes:
        """The library for texts with unusual characters; its long unsplit pieces still go through the tree."""
        if self.words or len(text) <= self.leaf:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        parts: list[bytes] = []
        for span, special in self._special_spans(text):
            if special:
                parts.append(np.array([self.library.token_to_id(span)], np.uint32).tobytes())
                continue
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(span):
                if piece not in self.mapped:
                    self.mapped[piece] = np.array(self.tree(piece), np.uint32).tobytes()
                parts.append(self.mapped[piece])
        return b"".join(parts)

    def _special_spans(self, text: str) -> list[tuple[str, bool]]:
        pattern = "|".join(regex.escape(s) for s in self.special)
        return [(s, s in self.special) for s in regex.split(f"({pattern})", text) if s]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 text of ids of a byte-level file, with special tokens; broken characters as the library shows them."""
        table = self.token_bytes
        raw = b"".join([table[i] for i in ids.tolist()])
        return raw.decode("utf-8", "replace").encode()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One encoder for each file and worker process."""
    return Bpe(path)


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (array of int): the tokens of every whole text.

    Null and empty texts have no ids. Rows with a null or repeated id are encoded like any other. Other
    columns are left out. A text is handled within one row, so memory is bounded by the longest text.
    """

    def run(batch: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        ids = [np.frombuffer(b, np.uint32) for b in bpe.encode_batch(batch.column(1).to_pylist())]
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])

    return _map_texts(docs, id_col, text_col, run, "doc_id long, ids array<int>", path)


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text``: the text of each row's ids, special tokens included; null ids give an empty text."""

    def run(batch: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        texts = [bpe.decode(np.array(i or [], np.int64)).decode() for i in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    chosen = tokens.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids")
    return arrow_map(chosen, run, "doc_id long, text string", lambda: load(path))


def _map_texts(docs: DataFrame, id_col: str, text_col: str, run, schema: str, path: str) -> DataFrame:
    def parts(batch: pa.RecordBatch, bpe: Bpe) -> pa.Table:
        return pa.Table.from_batches([run(part, bpe) for part in slices(batch, 1, SLICE)])

    return arrow_map(id_and_text(docs, id_col, text_col), parts, schema, lambda: load(path))


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each text, encoded and decoded in one pass."""
    import hashlib

    def run(batch: pa.RecordBatch, bpe: Bpe) -> pa.RecordBatch:
        counts, ids_sha, text_sha = [], [], []
        for raw in bpe.encode_batch(batch.column(1).to_pylist()):
            ids = np.frombuffer(raw, np.uint32)
            counts.append(len(ids))
            ids_sha.append(hashlib.sha256(",".join([bpe.decimal[i] for i in ids.tolist()]).encode()).hexdigest())
            text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _map_texts(docs, id_col, text_col, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", path)
