"""SentencePiece BPE encoding and decoding in vectorised merge rounds (operator 7).

A text becomes one symbol for each character, with a space symbol (U+2581) in front and for every space.  BPE
merges the adjacent pair of the highest score first, the leftmost among equals.  No piece holds a space
symbol after another character, so a text falls into words (space symbols, then other characters) that merge
apart from each other, and each distinct word of a batch is encoded once.

All symbols of all those words lie in one flat numpy array.  A round looks up the rank of every adjacent pair,
takes the minimum of each word, merges that pair at all its places at once, from the left and without
overlap, and compacts the array; words without a pair that can merge leave it.  Merging all places at once
equals merging them one by one as long as the new symbol can't form a pair of the same or a better
rank.  Where it can, or where different pieces share a rank, only the leftmost place is merged in that round.
Words that are not done after MAX_ROUNDS rounds (very long runs without spaces) go on with a heap,
which gives the same result.

Characters outside the vocabulary become their UTF-8 bytes' pieces, or the unknown id if the model has none.
Only the model's own tables are read; they are sent to the executors and are bounded by the vocabulary.

Cases: a null text counts as empty; an empty text has no ids; a space symbol in the text counts as a space
and decodes to one; repeated rows are all kept; empty tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
NO_RANK = np.iinfo(np.int32).max
MAX_ROUNDS = 400
#: Encoded words that a task keeps, and documents that it encodes together.
KEEP = 400_000
TOGETHER = 1000
#: Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message; length-delimited and fixed ones as bytes."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield number, data[at : at + size]
            at += size


def load_model(path: str) -> dict:
    """The tables of a BPE model file, as plain dicts and arrays.

    Raises ValueError for models that need what this operator leaves out: another algorithm, a
    character map, removal of extra spaces, user-defined symbols or spaces after words.
    """
    with open(path, "rb") as f:
        message = list(_fields(f.read()))
    trainer = dict(_fields(next(v for k, v in message if k == 2)))
    normal = dict(_fields(next(v for k, v in message if k == 3)))
    pieces, scores, types = [], [], []
    for number, value in message:
        if number == 1:
            one = dict(_fields(value))
            pieces.append(one[1].decode())
            scores.append(struct.unpack("<f", one[2])[0] if 2 in one else 0.0)
            types.append(one.get(3, NORMAL))
    if trainer.get(3) != 2 or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or {USER_DEFINED, UNUSED} & set(types):
        raise ValueError(f"{path}: only plain BPE models without normalisation are supported")
    usable = {p: i for i, p in enumerate(pieces) if types[i] == NORMAL}
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in usable):
        raise ValueError(f"{path}: pieces that span words aren't supported")
    symbols = dict(usable)
    for p in usable:
        for c in p:
            symbols.setdefault(c, len(pieces) + len(symbols))  # a character that is part of pieces but none itself
    order = {s: k for k, s in enumerate(sorted({scores[i] for i in usable.values()}, reverse=True))}
    keys, ranks, merged = [], [], []
    for p, i in usable.items():
        for cut in range(1, len(p)):
            a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                ranks.append(order[scores[i]])
                merged.append(i)
    slots = 1 << max(4, (4 * len(keys)).bit_length())
    table = _hash_table(np.array(keys, np.int64), slots)
    # a rank must be merged one place at a time if pieces share it, or if its piece can be part of one as good or better
    n_of_rank = np.bincount([order[scores[i]] for i in usable.values()], minlength=len(order))
    careful = n_of_rank > 1
    own = {i: order[scores[i]] for i in usable.values()}
    for key, rank in zip(keys, ranks):
        for part in (key >> 32, key & 0xFFFFFFFF):
            if own.get(part, -1) >= rank:
                careful[own[part]] = True
    return {
        "pieces": pieces, "types": types, "symbols": symbols, "usable": frozenset(usable.values()), "keys": np.array([*keys, -1], np.int64), "ranks": np.array([*ranks, NO_RANK], np.int32), "merged": np.array([*merged, -1], np.int32),
        "table": table, "careful": careful, "text": [str(i) for i in range(len(pieces))], "plain": [p.replace(SPACE, " ") if t == NORMAL else None for p, t in zip(pieces, types)],
        "byte": [pieces.index(f"<0x{b:02X}>") for b in range(256)] if trainer.get(35) else None, "unknown": types.index(UNKNOWN),
        "prefix": bool(normal.get(3, 1)), "unknown_text": trainer.get(44, " ⁇ ".encode()).decode(),
    }


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def _hash_table(keys: np.ndarray, slots: int) -> np.ndarray:
    """Places of the keys by hash, with linear probing; len(keys) where a slot is empty."""
    table = np.full(slots, len(keys), np.int32)
    for place, at in enumerate(_slot(keys, slots).tolist()):
        while table[at] != len(keys):
            at = (at + 1) % slots
        table[at] = place
    return table


def _pair_ranks(model: dict, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged piece of pairs of symbols; NO_RANK where they make no piece."""
    keys, table = model["keys"], model["table"]
    key = left << 32 | right
    at = _slot(key, len(table))
    place = table[at]
    none = len(keys) - 1  # its key is -1, which no pair has
    todo = np.flatnonzero((keys[place] != key) & (place != none))
    while len(todo):
        at[todo] = (at[todo] + 1) % len(table)
        place[todo] = table[at[todo]]
        todo = todo[(keys[place[todo]] != key[todo]) & (place[todo] != none)]
    place[(left < 0) | (right < 0)] = none
    return model["ranks"][place], model["merged"][place]


def _heap_merge(model: dict, symbols: list[int]) -> list[int]:
    """Merge one word pair by pair: the plain algorithm, for words that need very many rounds."""
    n = len(symbols)
    ranks, merged = (x.tolist() for x in _pair_ranks(model, np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64)))
    heap = [(r, i, symbols[i], symbols[i + 1], m) for i, (r, m) in enumerate(zip(ranks, merged)) if r != NO_RANK]
    heapq.heapify(heap)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now: list[int | None] = list(symbols)
    table: dict[tuple[int, int], tuple[int, int]] = {}

    def push(i, j):
        if i >= 0 and j < n:
            pair = (now[i], now[j])
            if pair not in table:
                r, m = _pair_ranks(model, np.array([pair[0]], np.int64), np.array([pair[1]], np.int64))
                table[pair] = int(r[0]), int(m[0])
            if table[pair][0] != NO_RANK:
                heapq.heappush(heap, (table[pair][0], i, *pair, table[pair][1]))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = after[i]
        if now[i] != a or j >= n or now[j] != b:
            continue
        now[i], now[j] = m, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        push(before[i], i)
        push(i, after[i])
    return [x for x in now if x is not None]


def merge_words(model: dict, words: list[str]) -> list[list[int]]:
    """Final symbols of each word (spaces as space symbols); characters outside all pieces are -1 - code point."""
    symbol = model["symbols"]
    sizes = np.array([len(w) for w in words], np.int64)
    chars = "".join(words)
    codes = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    known = np.flatnonzero(seen)
    to_symbol = np.empty(0x110000, np.int64)
    to_symbol[known] = [symbol.get(chr(c), -1 - c) for c in known.tolist()]
    sym = to_symbol[codes]
    word = np.repeat(np.arange(len(words)), sizes)
    done_sym, done_word = [], []
    out: list[list[int] | None] = [None] * len(words)
    # rank and piece of each symbol with its successor; only those next to a merge change
    rank, piece = np.full(len(sym), NO_RANK, np.int32), np.full(len(sym), -1, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner], piece[inner] = _pair_ranks(model, sym[inner], sym[inner + 1])
    rounds = 0
    while len(sym):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        best = np.minimum.reduceat(rank, first)
        best_here = np.repeat(best, np.diff(np.append(first, len(sym))))
        active = best_here != NO_RANK
        if not active.all():
            done_sym.append(sym[~active])
            done_word.append(word[~active])
            sym, word, rank, piece, best_here = sym[active], word[active], rank[active], piece[active], best_here[active]
            if not len(sym):
                break
        # consecutive places overlap: every other one, from the left
        place = np.flatnonzero(rank == best_here)
        run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
        start = np.repeat(place[run], np.diff(np.append(run, len(place))))
        place = place[(place - start) % 2 == 0]
        one = model["careful"][best_here[place]]
        if one.any():
            place = place[~one | np.r_[True, word[place][1:] != word[place][:-1]]]
        sym[place] = piece[place]
        keep = np.ones(len(sym), bool)
        keep[place + 1] = False
        now = place - np.arange(len(place))  # where the merged symbols are after compaction
        sym, word, rank, piece = sym[keep], word[keep], rank[keep], piece[keep]
        near = np.zeros(len(sym) + 1, bool)
        near[now] = near[now - 1] = True  # now - 1 may be the spare last place
        changed = np.flatnonzero(near[:-1])
        rank[changed] = NO_RANK
        changed = changed[changed < len(sym) - 1]
        changed = changed[word[changed] == word[changed + 1]]
        rank[changed], piece[changed] = _pair_ranks(model, sym[changed], sym[changed + 1])
        rounds += 1
        if rounds >= MAX_ROUNDS and len(sym):
            for w in np.unique(word).tolist():
                out[w] = _heap_merge(model, sym[word == w].tolist())
            break
    if done_sym:
        flat, owner = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order].tolist(), owner[order]
        ends = np.searchsorted(owner, np.arange(len(words)), side="right").tolist()
        begin = 0
        for w, end in enumerate(ends):
            if out[w] is None:
                out[w] = flat[begin:end]
            begin = end
    return [x or [] for x in out]


def _to_ids(model: dict, symbols: list[int]) -> list[int]:
    """Piece ids of symbols; those outside the vocabulary as bytes or as one unknown id."""
    if not symbols or min(symbols) >= 0 and max(symbols) < len(model["pieces"]):
        return symbols
    ids: list[int] = []
    names = None
    for s in symbols:
        if s in model["usable"]:
            ids.append(s)
            continue
        if s >= 0 and names is None:
            names = {i: p for p, i in model["symbols"].items()}
        text = names[s] if s >= 0 else chr(-1 - s)
        if model["byte"]:
            ids += [model["byte"][b] for b in text.encode("utf-8", "surrogatepass")]
        elif not ids or ids[-1] != model["unknown"]:
            ids.append(model["unknown"])
    return ids


def split_words(model: dict, text: str) -> list[str]:
    """The words of a text, with space symbols."""
    if not text:
        return []
    text = text.replace(" ", SPACE)
    return re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", SPACE + text if model["prefix"] else text)


def encode(model: dict, texts: list[str]) -> list[list[int]]:
    """Ids of each text."""
    words = [split_words(model, t) for t in texts]
    distinct = list({w for ws in words for w in ws})
    ids = dict(zip(distinct, (_to_ids(model, s) for s in merge_words(model, distinct))))
    return [[i for w in ws for i in ids[w]] for ws in words]


def _utf8(data: bytes) -> str:
    """Bytes as text; each byte that isn't part of a valid character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError as e:
        return data[: e.start].decode() + "�" + _utf8(data[e.start + 1 :])


def decode(model: dict, ids: Iterable[int], beginning: bool = True) -> str:
    """The text of ids.  ``beginning``: they start the text, where the prefix's space is taken off."""
    out, run = [], bytearray()
    strip = beginning and model["prefix"]
    for i in ids:
        kind = model["types"][i]
        if kind == BYTE:
            run.append(int(model["pieces"][i][3:5], 16))
            strip = False
            continue
        if run:
            out.append(_utf8(bytes(run)))
            run.clear()
        if kind == CONTROL:
            continue
        if kind == UNKNOWN:
            piece = model["unknown_text"]
        else:
            piece = model["pieces"][i]
            if strip and piece.startswith(SPACE):
                piece = piece[1:]
            piece = piece.replace(SPACE, " ")
        out.append(piece)
        strip = False
    if run:
        out.append(_utf8(bytes(run)))
    return "".join(out)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, an array, on request) of each row's whole text."""
    model = docs.sparkSession.sparkContext.broadcast(load_model(model_path))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        m = model.value
        known: dict[str, tuple[str, int, str]] = {}
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                words = [split_words(m, t or "") for t in part["text"]]
                if len(known) > KEEP:
                    known.clear()
                new = list({w for ws in words for w in ws if w not in known})
                text, plain = m["text"], m["plain"]
                for w, symbols in zip(new, merge_words(m, new)):
                    ids = _to_ids(m, symbols)
                    parts = [plain[i] for i in ids]
                    known[w] = ",".join([text[i] for i in ids]), len(ids), decode(m, ids, beginning=False) if None in parts else "".join(parts)
                rows = []
                for doc_id, ws in zip(part["doc_id"], words):
                    own = [known[w] for w in ws]
                    ids = ",".join([x[0] for x in own])
                    # the first word's space is the prefix's
                    text = "".join([x[2] for x in own])
                    if ws and m["prefix"]:
                        head = decode(m, map(int, own[0][0].split(",")))
                        text = head + text[len(own[0][2]) :]
                    row = [doc_id, sum(x[1] for x in own), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()]
                    rows.append(row + [[int(i) for i in ids.split(",")] if ids else []] * with_ids)
                yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids).astype({"doc_id": "string"}).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(run, schema)


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(MODEL))


SPARK = {"op7_piece_bpe": op7_piece_bpe}
SQL: dict[str, str] = {}
