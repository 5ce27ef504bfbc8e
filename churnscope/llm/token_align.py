"""Alignment of two tokenizers' tokens by interval coalescing (operator 13).

A text is encoded by a byte-level BPE (A) and by a SentencePiece model (B); tokens are intervals of bytes of the same string.

1. All A and B tokens of many texts, laid end to end, are sorted with ``lexsort`` by start (A first).  ``maximum.accumulate``
   over their ends gives the running maximum; a group breaks where a start reaches it, which is where tokens of both end.
2. Overlaps expand within the groups: the sorted order tells how many B tokens start before an A token's start
   and end, so each A token's links are a range of B tokens, and all of them are laid out at once.
3. A pair of ids counts once for each document that holds it linked.  A task writes blocks of documents: each
   distinct pair of a block once, with its number of documents, and each document's links as places in that list.
   Sums over blocks give the corpus-wide counts, and each block looks up its own pairs, so a pair that is in every document is
   one row for each block, never one for each link.  The largest count of an A id is a table of at most the vocabulary's size.

Encoding uses the public libraries.  A's vocabulary is read from its file; where its merges are in the order of their
ids (checked on loading) the faster of two libraries with that very result is used, except for texts above LONG characters.

Cases: a text that is null or empty, or whose tokens' bytes don't give it back (a U+2581 in it, for B), has no tokens: zeros and ''.
Special tokens' strings in texts are plain text; rows that repeat an id or a text each count as a document; a row without id is
one too, and keeps its null id; empty tables give empty results; other columns don't matter.  Blocks are bounded by BLOCK
characters or one text.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SPACE = "▁"
# fixed values: how byte-level vocabularies split a text
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of texts that a task aligns together, that a block holds, and above which the plain library encodes.
TOGETHER, BLOCK, LONG = 1 << 20, 1 << 24, 100_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Coder:
    """Both tokenizers, from their files' contents, with their tokens' bytes; made once in each task."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        import tokenizers

        file = json.loads(a_file)
        self.a_model = tokenizers.Tokenizer.from_buffer(a_file)
        self.a_model.encode_special_tokens = True
        letters, vocab = _byte_letters(), file["model"]["vocab"]
        special = {t["id"]: t["content"].encode() for t in file["added_tokens"]}
        size = self.a_model.get_vocab_size(with_added_tokens=True)
        self.a_bytes: list[bytes] = [special.get(i, b"") for i in range(size)]
        for word, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in word)
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        pre = file["pre_tokenizer"]
        ranked = made == sorted(made) and len(set(made)) + 256 == len(vocab) and pre["type"] == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"] and not file.get("normalizer") and not file["model"].get("ignore_merges")
        self.a_fast = None
        if ranked:
            self.a_fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values()}, special_tokens={})
        self.b_model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_bytes: list[bytes] = []
        for i in range(self.b_model.get_piece_size()):
            piece = self.b_model.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b_model.is_byte(i) else piece.replace(SPACE, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in many], np.int64) for many in (self.a_bytes, self.b_bytes))
        ids = [str(i) for i in range(len(self.a_bytes))] + [str(i) for i in range(len(self.b_bytes))]
        self.written = np.array([i + end for end in (",", "|", ";", "") for i in ids], object)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """A and B ids of each text; none where the text is null or empty or isn't given back."""
        spaced = [" " + t if t else "" for t in texts]
        if self.a_fast:
            a = [self.a_fast.encode_ordinary(t) if len(t) <= LONG else self.a_model.encode(t, add_special_tokens=False).ids for t in spaced]
        else:
            a = [e.ids for e in self.a_model.encode_batch(spaced, add_special_tokens=False)]
        b = self.b_model.encode([t or "" for t in texts], num_threads=1)
        take_a, take_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for k, text in enumerate(spaced):
            whole = text.encode("utf-8", "surrogatepass")
            if not text or b"".join(map(take_b, b[k])) != whole or b"".join(map(take_a, a[k])) != whole:
                a[k], b[k] = [], []
        return a, b


def _files(spark: SparkSession, *paths: str):
    """The files' contents, read by the driver and sent to the executors (two vocabularies, a few MB)."""
    found = []
    for path in paths:
        with open(path, "rb") as f:
            found.append(f.read())
    return spark.sparkContext.broadcast(tuple(found))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All values, and how many each list has."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((x for one in lists for x in one), np.int64, int(sizes.sum())), sizes


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> dict[str, np.ndarray]:
    """Groups and links of two series of tokens that cover the same bytes, from their ends.

    order: the tokens (A's numbers, then B's from len(a_ends) on) by start; group: the group of each in that order;
    a, b: the linked tokens' numbers, by a and b.
    """
    n_a, n_b = len(a_ends), len(b_ends)
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([a_ends[:1] * 0, a_ends[:-1], b_ends[:1] * 0, b_ends[:-1]])
    kind = np.repeat(np.array([0, 1], np.int8), [n_a, n_b])
    order = np.lexsort((kind, starts))
    running = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= running[:-1]
    group = np.cumsum(breaks) - 1
    # B tokens that start before each A token: its place in the order without the A tokens before it
    before = np.flatnonzero(order < n_a) - np.arange(n_a)
    a_starts = starts[:n_a]
    low = before - ((before > 0) & (b_ends[before - 1] > a_starts)) if n_b else before
    high = np.append(before[1:], n_b)
    per_a = np.maximum(high - low, 0)
    a = np.repeat(np.arange(n_a), per_a)
    b = np.arange(len(a)) - np.repeat(np.cumsum(per_a) - per_a, per_a) + np.repeat(low, per_a)
    return {"order": order, "group": group, "a": a, "b": b}


def align_texts(c: Coder, texts: list[str | None]) -> dict:
    """Ids, groups and links of many texts, laid end to end; n_a, n_b, n_groups, n_links for each text."""
    a_lists, b_lists = c.encode(texts)
    (a_ids, n_a), (b_ids, n_b) = _flat(a_lists), _flat(b_lists)
    found = align(np.cumsum(c.a_size[a_ids]), np.cumsum(c.b_size[b_ids]))
    n = len(texts)
    a_doc, b_doc = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    doc = np.concatenate([a_doc, b_doc])[found["order"]]
    opens = np.diff(found["group"], prepend=-1) > 0
    return found | {"a_ids": a_ids, "b_ids": b_ids, "a_doc": a_doc, "doc": doc, "n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc[opens], minlength=n), "n_links": np.bincount(a_doc[found["a"]], minlength=n)}


def written_groups(c: Coder, found: dict) -> list[str]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    order, n_a = found["order"], len(found["a_ids"])
    is_b = order >= n_a
    own = found["group"] * 2 + is_b
    inside = np.argsort(own, kind="stable")  # a group's A tokens, then its B tokens
    own, doc, order = own[inside], found["doc"][inside], order[inside]
    ids = np.concatenate([found["a_ids"], found["b_ids"] + len(c.a_bytes)])[order]
    end = np.full(len(own), 3)
    step = own[1:] - own[:-1]
    end[:-1] = np.where(step == 0, 0, np.where((step == 1) & (own[:-1] % 2 == 0), 1, 2))
    sizes = found["n_a"] + found["n_b"]
    stops = np.cumsum(sizes)
    end[stops[sizes > 0] - 1] = 3
    tokens = c.written[end * (len(c.a_bytes) + len(c.b_bytes)) + ids].tolist()
    return ["".join(tokens[stop - size : stop]) for stop, size in zip(stops.tolist(), sizes.tolist())]


def _pieces(texts: list[str | None], most: int):
    """Ranges of texts with at most ``most`` characters together, or one text."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        size = len(t or "") + 64
        if i > at and chars + size > most:
            yield at, i
            at, chars = i, 0
        chars += size
    if at < len(texts):
        yield at, len(texts)


def align_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids, group_ends (byte offsets where tokens of both end), links (array of places of an A and a B token)."""
    files = _files(docs.sparkSession, a_path, b_path)

    def run(batches):
        c = Coder(*files.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for i, j in _pieces(texts, TOGETHER):
                found = align_texts(c, texts[i:j])
                a_at, b_at = (np.cumsum(found[x]) - found[x] for x in ("n_a", "n_b"))
                a_ends = np.cumsum(c.a_size[found["a_ids"]])
                of_a = found["order"] < len(a_ends)
                last = np.flatnonzero(np.diff(found["group"][of_a], append=-1) != 0)  # a group's last A token ends it
                ends, end_doc = a_ends[last], found["a_doc"][last]
                link_doc = found["a_doc"][found["a"]]
                rows = []
                for k in range(j - i):
                    own, base = link_doc.searchsorted([k, k + 1]), a_at[k]
                    begin = a_ends[base - 1] if base else 0
                    g = end_doc.searchsorted([k, k + 1])
                    links = [{"a": x, "b": y} for x, y in zip((found["a"][own[0] : own[1]] - base).tolist(), (found["b"][own[0] : own[1]] - b_at[k]).tolist())]
                    rows.append([pdf["doc_id"].iloc[i + k], found["a_ids"][base : base + found["n_a"][k]], found["b_ids"][b_at[k] : b_at[k] + found["n_b"][k]], ends[g[0] : g[1]] - begin, links])
                yield pd.DataFrame(rows, columns=["doc_id", "a_ids", "b_ids", "group_ends", "links"]).astype({"doc_id": "string"}).astype({"doc_id": "Int64"})

    return _texts(docs).mapInPandas(run, "doc_id long, a_ids array<int>, b_ids array<int>, group_ends array<long>, links array<struct<a: int, b: int>>")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


_BLOCK = "block string, keys array<long>, n_docs array<long>, doc_ids array<string>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, n_pairs array<long>, places binary, times binary"


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(np.uint32).tobytes())


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(blob)), np.uint32).astype(np.int64)


def _blocks(docs: DataFrame, files) -> DataFrame:
    """Blocks of documents: their distinct linked id pairs (keys, n_docs) and, for each document, its figures and the places
    of its own pairs in that list, with how many times it holds each."""

    def run(batches):
        from pyspark import TaskContext

        c, part, made = Coder(*files.value), TaskContext.get().partitionId(), 0
        width = len(c.b_bytes)
        for pdf in batches:
            texts, doc_ids = pdf["text"].tolist(), pdf["doc_id"].tolist()
            for begin, end in _pieces(texts, BLOCK):
                figures: dict[str, list] = {x: [] for x in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs")}
                keys, times = [], []
                for i, j in _pieces(texts[begin:end], TOGETHER):
                    found = align_texts(c, texts[begin + i : begin + j])
                    span = len(c.a_bytes) * width
                    pairs = np.sort(found["a_doc"][found["a"]] * span + found["a_ids"][found["a"]] * width + found["b_ids"][found["b"]])
                    first = np.flatnonzero(np.diff(pairs, prepend=-1))
                    keys.append(pairs[first] % span)
                    times.append(np.diff(first, append=len(pairs)))
                    for x in ("n_a", "n_b", "n_groups", "n_links"):
                        figures[x].append(found[x])
                    figures["n_pairs"].append(np.bincount(pairs[first] // span, minlength=j - i))
                    figures["groups_sha256"].append([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in written_groups(c, found)])
                distinct, place, n_docs = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
                row = {"block": f"{part}-{made}", "keys": distinct, "n_docs": n_docs, "doc_ids": [None if d is None or d != d else d for d in doc_ids[begin:end]]}
                row |= {x: np.concatenate(v) for x, v in figures.items()} | {"places": _pack(place), "times": _pack(np.concatenate(times))}
                yield pd.DataFrame([row])
                made += 1

    return _texts(docs).mapInPandas(run, _BLOCK)


def link_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of (doc_id, text)."""
    files = _files(docs.sparkSession, a_path, b_path)
    blocks = materialise(_blocks(docs, files), "aligned", "zstd")
    width = len(Coder(*files.value).b_bytes)
    pairs = blocks.select(F.explode(F.arrays_zip("keys", "n_docs")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.n_docs").alias("n"))
    counts = materialise(pairs.groupBy("key").agg(F.sum("n").alias("n")), "pairs", "zstd")
    a_id = F.floor(F.col("key") / width)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))  # a row for each A id at most: bounded by the vocabulary
    marked = counts.withColumn("a", a_id).join(F.broadcast(most), "a").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    wanted = blocks.select(F.col("block").alias("of"), F.explode("keys").alias("key")).join(marked, "key").select("of", "key", "n", "best")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def finish(own, known):
        known = known.sort_values("key")
        n, best = known["n"].to_numpy(np.int64), known["best"].to_numpy(np.int64)
        parts = []
        for row in own.to_dict("records"):
            place, times, sizes = _unpack(row["places"]), _unpack(row["times"]), np.asarray(row["n_pairs"], np.int64)
            stops = np.cumsum(sizes)
            sums = [np.r_[0, np.cumsum(v[place] * times)] for v in (best, n)] if len(n) else [np.zeros(1, np.int64)] * 2
            one = pd.DataFrame({x: row[x] for x in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")})
            one["doc_id"] = pd.Series(list(row["doc_ids"]), dtype="string").astype("Int64")
            one["n_best"], one["count_sum"] = (s[stops] - s[stops - sizes] for s in sums)
            parts.append(one[columns])
        return pd.concat(parts) if parts else pd.DataFrame(columns=columns)

    figures = blocks.select("block", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_pairs", "places", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return figures.groupBy("block").cogroup(wanted.groupBy("of")).applyInPandas(finish, schema)


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return link_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE))


SPARK = {"op13_token_align": op13_token_align}
SQL: dict[str, str] = {}
