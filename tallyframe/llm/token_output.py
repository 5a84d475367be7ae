"""Token ids as binary files: independent zstandard frames, a trailing seek table, a checksum for each frame."""

from __future__ import annotations

import gc
import json
import os
import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batch, ids_texts, shared_dir, stored

SKIPPABLE, TABLE, TABLE_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the zstandard formats


class Recent:
    """A store of results by key: at most two generations of `size` keys (and one batch's), the older goes when the newer is full."""

    def __init__(self, size: int):
        self.size, self.kept, self.older = size, {}, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that aren't known; the others then stand in kept."""
        if len(self.kept) > self.size:
            self.kept, self.older = {}, self.kept
        kept, older, out = self.kept, self.older, []
        for key in keys.difference(kept):
            have = older.get(key)
            if have is None:
                out.append(key)
            else:
                kept[key] = have
        return out


class WordEncoder:
    """Ids of whole texts by the tokenizers library, each distinct word encoded once and kept.

    The tokenizer must treat the parts between ASCII white space apart, as its file does when its normaliser and its pattern
    only join or match what no white space divides and drop white space itself; _drops_white_space checks that on the file,
    and other files get whole texts. ASCII words are lower-cased and split further, into the pattern's matches, as the
    library would. If the file has nothing after its model (_ends_in_model), other words are normalised and split by the
    library's own steps, many at a time, and each part not met lately goes to the model alone. Else, and for words with control
    characters, Unicode spaces or the start of an added token, the library encodes it. Words of over 64 bytes aren't kept.
    """

    def __init__(self, path: str, cache_size: int = 1 << 18):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        self.by_word = _drops_white_space(config)
        self.model = self.tokenizer.model if self.by_word and _ends_in_model(config) else None
        self.words, self.parts = Recent(cache_size), Recent(cache_size)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_word:
            return self._encoded(texts)
        collects = gc.isenabled()
        gc.disable()  # it makes many small lists and no cycles
        try:
            return self._by_word(texts)
        finally:
            if collects:
                gc.enable()

    def _by_word(self, texts: list[str]) -> list[bytes]:
        found = [t.encode().split() for t in texts]  # bytes: ASCII white space only
        new = self.words.missing(set().union(*found))
        split = self._split(new)
        fresh = self.parts.missing(set().union(*split))
        known = self.parts.kept
        whole = [x for x in fresh if type(x) is bytes]
        for at in range(0, len(whole), 8192):
            part = whole[at : at + 8192]
            known.update(zip(part, self._encoded([w.decode() for w in part])))
        for x in fresh:
            if type(x) is str:
                known[x] = struct.pack(f"<{len(ids := [t.id for t in self.model.tokenize(x)])}I", *ids)
        kept = self.words.kept
        for word, parts in zip(new, split):
            kept[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])
        out = [b"".join(map(kept.__getitem__, words)) for words in found]
        for store, added in ((known, fresh), (kept, new)):
            for word in added:
                if len(word) > 64:
                    del store[word]
        return out

    def _split(self, words: list[bytes]) -> list[list]:
        """The parts of each word: text for the model, as its byte level writes it, or bytes for the whole library."""
        if self.model is None:
            return [ASCII_PARTS.findall(w.lower()) if w.isascii() and b"<|" not in w else [w] for w in words]
        out: list[list] = [[w] for w in words]
        others = []
        for i, w in enumerate(words):
            if b"<|" not in w:
                t = w.decode()
                if not w.isascii():
                    if t.split() == [t]:
                        others.append((i, t))
                elif t.isprintable():  # these the byte level leaves as they are
                    out[i] = ASCII_TEXT_PARTS.findall(t.lower())
        for at in range(0, len(others), 256):
            some = others[at : at + 256]
            text = self.tokenizer.normalizer.normalize_str(" ".join([t for _, t in some]))
            normal = text.split(" ")
            if len(normal) == len(some):
                parts, k, end = [[] for _ in some], 0, len(normal[0])
                for x, (a, _) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text):
                    while a >= end:
                        k += 1
                        end += 1 + len(normal[k])
                    parts[k].append(x)
                for (i, _), x in zip(some, parts):
                    out[i] = x
        return out

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return list(map(self._raw, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    @staticmethod
    def _raw(encoding) -> bytes:
        ids = encoding.ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _drops_white_space(config: dict) -> bool:
    """Whether words can be encoded one by one: normalisers that act within words, and a first split that keeps no white space."""
    parts = lambda x, name: (x or {}).get(name, [x] if x else [])
    normal = [x["type"] for x in parts(config["normalizer"], "normalizers")][-1:] == ["Lowercase"] and all(x["type"] in ("NFC", "NFD", "Lowercase") or x["type"] == "Replace" and x["content"] == " " and x["pattern"] == {"Regex": "\\s+"} for x in parts(config["normalizer"], "normalizers"))
    first = (parts(config["pre_tokenizer"], "pretokenizers") or [{}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # Fixed value: the one pattern known to match no white space and to need none on either side.
    known = pattern == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    plain = not config["truncation"] and not config["padding"] and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) and " " not in x["content"] for x in config["added_tokens"])
    return normal and plain and known and first.get("type") == "Split" and first.get("invert") is True and first.get("behavior") == "Removed"


def _ends_in_model(config: dict) -> bool:
    """Whether a part, once split and written by its byte level, goes to a plain model and its ids come out as they are."""
    steps = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    level = steps[1] if len(steps) == 2 else {}
    return level.get("type") == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"] and config["post_processor"] is None and config["model"]["type"] == "BPE" and not config["model"]["dropout"]


#: The pattern above on lower-case ASCII without white space.
ASCII_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
ASCII_TEXT_PARTS = re.compile(ASCII_PARTS.pattern.decode())


@lru_cache(4)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class FrameWriter:
    """Writes documents' ids into frames of about frame_bytes; a document lies in one frame.

    After the data frames follow a skippable frame with (doc_id, has_id, n_ids, frame) of each document and the seek table:
    compressed size, size and low half of xxh64 of each frame.
    """

    def __init__(self, out, frame_bytes: int = 1 << 18):
        self.out, self.frame_bytes, self.held, self.n_held = out, frame_bytes, [], 0
        self.docs, self.frames = [], []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        """raw: ids as little-endian unsigned 32-bit integers."""
        self.docs.append((doc_id or 0, doc_id is not None, len(raw) // 4, len(self.frames)))
        self.held.append(raw)
        self.n_held += len(raw)
        if self.n_held >= self.frame_bytes:
            self.flush()

    def flush(self) -> None:
        raw = b"".join(self.held)
        frame = zstandard.ZstdCompressor(level=3, write_content_size=True).compress(raw)
        self.out.write(frame)
        self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.n_held = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        index = np.array(self.docs, dtype=DOC).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, TABLE_END)
        self.out.write(struct.pack("<II", TABLE, len(table)) + table)


DOC = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("n", "<u4"), ("frame", "<u4")])


class FrameReader:
    """Reads single documents: seeks to their frame and decompresses that frame only, checking its checksum."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != TABLE_END:
            raise ValueError("no seek table")
        source.seek(size - 9 - 12 * n)
        self.frames = [struct.unpack("<III", source.read(12)) for _ in range(n)]
        self.at = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)]).astype(np.int64)
        source.seek(int(self.at[-1]))
        self.docs = np.frombuffer(source.read(struct.unpack("<II", source.read(8))[1]), DOC)

    def frame(self, k: int) -> np.ndarray:
        stored_size, raw_size, check = self.frames[k]
        self.source.seek(int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.source.read(stored_size), max_output_size=max(1, raw_size))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def __iter__(self):
        k, ids, at = -1, None, 0
        for doc_id, has_id, n, frame in self.docs.tolist():
            if frame != k:
                k, ids, at = frame, self.frame(frame), 0
            yield doc_id if has_id else None, ids[at : at + n]
            at += n

    def document(self, doc_id: int) -> np.ndarray:
        i = int(np.flatnonzero((self.docs["doc_id"] == doc_id) & self.docs["has_id"])[0])
        same = self.docs["frame"][:i] == self.docs["frame"][i]
        at = int(self.docs["n"][:i][same].sum())
        return self.frame(int(self.docs["frame"][i]))[at : at + int(self.docs["n"][i])]


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes one file for each range of doc_id and returns the manifest: part, path, n_docs, n_tokens.

    Texts are dealt by ranges of (doc_id, hash of the text, a random number), so that equal or null ids spread too, and sorted
    (null ids first, equal ids by that hash). Each task encodes its texts slice by slice and streams frames to a file under
    a name of its own attempt, moved into place at the end, so that lost or repeated tasks leave one whole file. A null text
    is empty: its ids are the end id alone. Repeated rows each have a place; extra columns are not read; an empty table gives
    no file.
    """
    folder = folder or shared_dir(docs.sparkSession)
    schema = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(frames):
        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        part, tries = task.partitionId(), task.taskAttemptId()
        name, own, n_docs, n_tokens, writer = f"{base}/part-{part:06d}.zst", f"{base}/_try-{part}-{tries}", 0, 0, None
        encoder = _encoder(tokenizer_path)
        for doc_ids, texts in ids_texts(frames):
            if writer is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(own)
                writer = FrameWriter(out)
            for doc_id, raw in zip(doc_ids, encoder.encode(texts)):
                writer.add(doc_id, raw + end)
                n_docs, n_tokens = n_docs + 1, n_tokens + len(raw) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            store.move(own, name)
            yield arrow_batch(schema, [part], [name], [n_docs], [n_tokens])

    keys = [F.col("doc_id"), F.xxhash64("text"), F.rand(7)]
    dealt = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*keys).sortWithinPartitions(*keys[:2])
    return stored(dealt.mapInArrow(run, "part long, path string, n_docs long, n_tokens long"))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a manifest; folder: the URI they were written to.

    A file's start is the sum of the counts of the files before it. The manifest has one row a file, of some tens of MB
    of text each, so a window over all of it is small.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(manifest.select("path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("start")))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(frames):
        store, _ = fs.FileSystem.from_uri(folder)
        for rb in frames:
            for path, start in zip(*(c.to_pylist() for c in rb.columns)):
                with store.open_input_file(path) as f:
                    rows = []
                    for doc_id, ids in FrameReader(f, f.size()):
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield arrow_batch(schema, *zip(*rows))
                            rows = []
                    if rows:
                        yield arrow_batch(schema, *zip(*rows))

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Writes all documents and returns what the files hold; see write_tokens and read_tokens."""
    folder = shared_dir(docs.sparkSession)
    return read_tokens(write_tokens(docs, tokenizer_path, folder, end_id), folder)
