"""Token counts of whole texts, long ones by overlapping chunks that are spliced at proven common boundaries.

**Chunks.** A text above `LONG` bytes is cut into chunks that overlap, and the library gives each chunk's tokens with their offsets. **Boundary.** A place where both chunks end a token, between
a byte that is not ASCII white space and one that is, both of them inside both chunks. No token may reach over such a place: vocabularies for the tokenizers library must split
words before the merges; of a sentencepiece model only those white-space bytes count that follow nothing but white space in any of its pieces (without any, its texts are not
cut). So what lies behind the place cannot change what lies before it: counts before it are taken from the left chunk, counts after it from the right one. A chunk's first
and last word may be cut; neither ends at such a place in both chunks. Where an overlap holds no common place (one very long word, or chunks that disagree), the overlap doubles.

Edge cases: null and empty texts have no tokens and no bytes; special strings in texts are handled as the library does by default; rows that repeat a document each get a row; null ids stay null;
counts have no ties; an empty table gives an empty result; extra columns are not read, whatever their names. A very long text is held whole, and encoded a chunk at a time.
"""

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meshloom.llm.arrow_text import SPACE, Memo, Words, split, texts

#: tokens of a piece, given its bytes
Encode = Callable[[list[bytes]], np.ndarray]
#: texts above so many bytes are cut, into chunks of this size with this overlap
LONG, OVERLAP = 32_768, 512


def library(path: str) -> Encode:
    """Token counts by the library that the file's kind names, without begin, end or added special tokens, padding or truncation."""
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: np.array([len(x) for x in sp.encode([b.decode("utf-8", "replace") for b in t], num_threads=1)], np.int32)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return lambda t: np.array([len(e) for e in tok.encode_batch_fast([b.decode("utf-8", "replace") for b in t], add_special_tokens=False)], np.int32)


#: fixed values: the kinds of splitting rules of which it is known that their words hold no white space and that white space is dropped, and of changes to texts that keep words apart
SPLITS = re.compile(r"(?:'[a-z]{1,2}\||\[\\p\{[LN]\}\]\+?\|)*\[\^\\s\\p\{L\}\\p\{N\}\]\+")
CHANGES = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}]


def splits_at_space(path: str) -> bool:
    """Whether the file is known to drop white space and to encode each word by itself, so that a text's tokens are those of its words. Only the rules in SPLITS and CHANGES are known."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    normal = d.get("normalizer") or {"type": "Sequence", "normalizers": []}
    changes = normal["normalizers"] if normal["type"] == "Sequence" else [normal]
    pre = d.get("pre_tokenizer") or {}
    first, *more = pre.get("pretokenizers") or [pre]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and SPLITS.fullmatch(pattern) is not None
    bytes_only = all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex", True) for x in more)
    plain = all(not any(t.get(k) for k in ("lstrip", "rstrip", "single_word")) and not any(c.isspace() for c in t["content"]) for t in d.get("added_tokens") or [])
    return words and bytes_only and plain and all(c in CHANGES for c in changes) and not d.get("post_processor") and not d["model"].get("dropout")


class Pieces:
    """Counts of white-space separated pieces, each encoded by the library once and then remembered."""

    def __init__(self, encode: Encode, bits: int = 21):
        self.encode, self.memo = encode, Memo(bits)

    def __call__(self, w: Words) -> np.ndarray:
        return self.memo.get(w.hashes(), lambda i: self.encode([w.text(k) for k in i]))[:, 0] if len(w.starts) else np.zeros(0, np.int32)


def _open(ends: np.ndarray, upto: np.ndarray, data: np.ndarray, white: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The ends that all tokens up to there share and that white space follows, and the tokens up to each."""
    last = np.append(ends[1:] > ends[:-1], True) if len(ends) else np.zeros(0, bool)
    if len(ends):
        last &= (ends >= len(data)) | white[data[np.minimum(ends, len(data) - 1)]]
    return ends[last], upto[last]


def _starts(data: np.ndarray) -> np.ndarray:
    """Bytes before each character, and before the end."""
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


class LibraryEnds:
    """Encodes a chunk into boundaries (bytes from the chunk's start) and the tokens up to each, and all its tokens, from the offsets that the tokenizers library gives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        got = self.tok.encode(data.tobytes().decode("utf-8", "replace"), add_special_tokens=False)
        ends = _starts(data)[np.array([e for _, e in got.offsets], np.int64)]
        return *_open(ends, np.arange(1, len(ends) + 1), data), len(ends)


class PieceEnds:
    """The same for a sentencepiece model; `white` are the bytes that no piece has after anything but white space, so that no piece reaches over a boundary before one."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i).replace("\u2581", " ") for i in range(self.sp.get_piece_size())]
        inner = {b for p in pieces for a, b in zip(p, p[1:], strict=False) if not a.isspace()}
        self.white = SPACE & ~np.array([chr(c) in inner for c in range(256)])

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        got = self.sp.encode(data.tobytes().decode("utf-8", "replace"), return_type="proto").pieces
        ends = np.array([p.end for p in got], np.int64)
        return *_open(ends, np.arange(1, len(ends) + 1), data, self.white), len(ends)


def count_long(encode, data: np.ndarray, size: int = LONG, overlap: int = OVERLAP) -> int:
    """Tokens of one text from overlapping chunks; encode(bytes) gives boundaries, the tokens up to each, and all tokens."""
    def cut(i: int) -> int:  # not inside a character
        while 0 < i < len(data) and data[i] & 0xC0 == 0x80:
            i -= 1
        return max(0, i)

    n = len(data)
    start, stop = 0, cut(min(n, size))
    ends, upto, held = encode(data[start:stop])
    total, since = 0, 0  # tokens before the last splice; those of this chunk before it
    while stop < n:
        width = overlap
        while True:
            begin, end = cut(max(start, stop - width)), cut(min(n, stop - width + size + width))
            right, r_upto, r_held = encode(data[begin:end])
            a, b = ends + start, right + begin
            # inside both chunks with the byte after it, and not an edge of either
            both = np.intersect1d(a[a < stop], b[(b > begin) & (b < end)])
            both = both[both > max(begin, start)]
            both = both[SPACE[data[both]] & ~SPACE[data[both - 1]]] if len(both) else both
            if len(both):
                break
            if begin <= start:  # the right chunk starts where the left one does and reaches further: it replaces it
                break
            width *= 2
        if len(both):
            p = both[0]
            total += int(upto[np.searchsorted(a, p)]) - since
            since = int(r_upto[np.searchsorted(b, p)])
            start = begin
        else:  # the same start, and the tokens spliced off before stay off
            size *= 2
        stop, ends, upto, held = end, right, r_upto, r_held
    return total + held - since


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", long: int = LONG, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens), a row for each row of docs; null is as empty. No shuffle: each text is counted where it is read.

    Texts above `long` bytes go through overlapping chunks. Of others, where the vocabulary file is known to encode white-space separated words by
    themselves (see `splits_at_space`), words are remembered, in a table of bounded size; else the library gets each text.
    """
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, n_bytes bigint, n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library(path)
        pieces = Pieces(encode) if splits_at_space(path) else None
        ends = PieceEnds(path) if path.endswith(".model") else LibraryEnds(path)
        whole = isinstance(ends, PieceEnds) and not ends.white.any()
        for batch in batches:
            data, off = texts(batch, text_column)
            sizes = np.diff(off)
            n = np.zeros(len(sizes), np.int64)
            cut = np.zeros(len(sizes), bool) if whole else sizes > long
            for i in np.flatnonzero(cut):
                n[i] = count_long(ends, data[off[i] : off[i + 1]], long, overlap)
            rest = np.flatnonzero(~cut)
            if pieces:
                for w in split(batch.select([text_column]).take(pa.array(rest)), text_column):
                    c = np.concatenate([[0], np.cumsum(pieces(w), dtype=np.int64)])
                    n[rest[w.first : w.last]] = np.diff(c[w.bounds])
            else:
                for i in range(0, len(rest), 64):
                    n[rest[i : i + 64]] = encode([data[off[k] : off[k + 1]].tobytes() for k in rest[i : i + 64]])
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_column)), pa.array(sizes), pa.array(n)], names=[id_column, "n_bytes", "n_tokens"])

    return docs.select(id_column, text_column).mapInArrow(run, schema)
