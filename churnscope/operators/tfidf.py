"""Character n-gram TF-IDF (J7-J10) as Spark jobs.

Semantics follow a char-analyzer TF-IDF: lower-cased text, n-grams of every
length in [2, 4] at every position, vocabulary = the ``max_features`` most
frequent terms over the corpus (ties: term ascending), raw counts, smooth idf
``ln((1+n)/(1+df)) + 1`` (trap T10: not Spark ML's IDF), rows L2-normalised.

Plan shape (linear in the text volume, no pairs, two passes over the texts):
  documents --repartition(id)--> term totals per task (numpy, ``_Totals``)
  -> sum by term (partial aggregation, shuffle by term)
  -> top-V vocabulary (TakeOrderedAndProject; V <= 2000 rows, so it may go to
  every task)
  -> counts per (id, term) of the vocabulary's terms only (numpy again; at most
  V rows a text, so terms that nobody weighs are never written)
  -> weights per (id, term) -> per-id norms with a window over id.
A ``mult`` column lets identical texts be counted once and weighted by their
multiplicity (used for employee profile texts).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import params as P
from ..functions.numeric import with_scalars
from ..functions.text import char_ngrams

#: Characters of text whose n-grams are sorted together, and distinct terms that a task holds before it hands them on, about.
TOGETHER, HELD = 250_000, 1_000_000
#: A character's number takes 16 bits, so up to four of them make a key of 64 bits.
BITS = 16
#: What the regex engine of ``char_ngrams`` gives for the second half of a character beyond 16 bits.
HALF = ord("?")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys of a sorted array begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _sums(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys, ascending, with the sums of their values; keys that come in ascending runs are only merged."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _starts(keys)
    return keys[at], *((np.add.reduceat(v[order], at) if len(at) else v) for v in values)


class _Totals:
    """Corpus frequency and document frequency of every n-gram of the texts that were added.

    Documents wait until about TOGETHER characters are there, then their n-grams are sorted together as numbers: the characters'
    numbers (as many bits each as the alphabet takes so far) followed by the document's."""

    def __init__(self, n_min: int, n_max: int):
        self.sizes = range(n_min, n_max + 1)
        self._start()

    def _start(self):
        self.chars = np.array([0, HALF], np.uint32)  # by number; number 0 parts the texts
        self.number = np.full(0x110000, -1, np.int32)
        self.number[HALF] = 1
        self.held = {n: (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)) for n in self.sizes}
        self.new = {n: [] for n in self.sizes}
        self.docs, self.mults, self.waiting = [], [], 0

    def _codes(self, text: str) -> np.ndarray | None:
        """The characters' numbers, then zeros up to where the next text may begin; None if there are too many characters."""
        points = _points(text)
        codes = np.zeros(len(points) + self.sizes[-1] - 1, np.int32)
        found = self.number[points]
        if found.min(initial=0) < 0:
            fresh = np.unique(points[found < 0])
            if len(self.chars) + len(fresh) > 2**BITS:
                return None
            self.number[fresh] = np.arange(len(self.chars), len(self.chars) + len(fresh))
            self.chars = np.append(self.chars, fresh)
            found = self.number[points]
        codes[: len(points)] = found
        return codes

    def add(self, texts: Iterator[str], mult: int):
        """Count the texts of one id, together one document; yields the totals so far when there are many."""
        own, parts, size = None, [], 0
        for text in texts:
            codes = self._codes(text)
            if codes is None:
                yield from self._plain(own, parts, chain([text], texts), mult)
                return
            parts.append(codes)
            size += len(codes)
            if size >= TOGETHER:  # a long document's n-grams are counted as its texts come in
                own, parts, size = self._own(own, parts), [], 0
        if own is None:
            self.docs.append(parts)
            self.mults.append(mult)
            self.waiting += size
        else:
            for n, (keys, uses) in self._own(own, parts).items():
                self.new[n].append((keys, uses * mult, np.full(len(keys), mult, np.int64)))
        if self.waiting >= TOGETHER or own is not None:
            self._count()
            new = sum(len(k[0]) for ks in self.new.values() for k in ks)
            old = sum(len(h[0]) for h in self.held.values())
            if new >= old or new + old >= HELD:
                self._merge()
                if sum(len(h[0]) for h in self.held.values()) >= HELD:
                    yield from self.totals()

    def _own(self, own: dict | None, parts: list) -> dict:
        """The uses of a document's n-grams, those of ``own`` added."""
        found = {n: (keys, uses) for n, (keys, uses, _) in self._grams([parts], [1]).items()}
        return found if own is None else {n: _sums(*(np.concatenate(x) for x in zip(own[n], found[n]))) for n in self.sizes}

    def _plain(self, own: dict | None, parts: list, texts: Iterator[str], mult: int):
        """An id whose texts bring in more characters than keys can tell apart; the next one starts with a new alphabet."""
        counts = Counter()
        for n, (keys, uses) in self._own(own, parts).items():
            counts.update(dict(zip(self._terms(keys, n), uses.tolist())))
        for text in texts:
            points = _points(text)
            for n in self.sizes:
                counts.update(text[i : i + n] for i in range(len(text) - n + 1))
                counts.update(chr(HALF) + text[i + 1 : i + n] for i in np.flatnonzero(points[: max(0, len(text) - n + 1)] > 0xFFFF))
        yield list(counts), [c * mult for c in counts.values()], [mult] * len(counts)
        yield from self.totals()

    def _terms(self, keys: np.ndarray, n: int) -> list[str]:
        codes = np.stack([(keys >> np.uint64(BITS * (n - 1 - j))) & np.uint64(2**BITS - 1) for j in range(n)], axis=1)
        text = self.chars[codes.astype(np.int64)].tobytes().decode("utf-32-le")
        return [text[k : k + n] for k in range(0, len(text), n)]

    def _grams(self, docs: list[list[np.ndarray]], mults: list[int]) -> dict:
        """By size: distinct n-grams, ascending, with their uses and the documents that hold them, both by multiplicity."""
        bits, last = int(len(self.chars) - 1).bit_length(), self.sizes[-1]
        of = (len(docs) - 1).bit_length()  # the document's number takes the lowest bits
        codes = np.concatenate([np.empty(0, np.int32), *chain(*docs), np.zeros(last, np.int32)])
        doc = np.repeat(np.arange(len(docs), dtype=np.uint64), [sum(map(len, parts)) for parts in docs])
        wide = np.flatnonzero((self.chars > 0xFFFF)[codes]) if self.chars.max() > 0xFFFF else np.empty(0, np.int64)
        mult, out = np.array(mults, np.int64), {}
        wordy = codes.astype(np.uint64)
        low, keys = np.uint64(bits), np.zeros(len(doc), np.uint64)
        for n in range(1, last + 1):
            keys = (keys << low) | wordy[n - 1 : n - 1 + len(doc)]
            if n not in self.sizes:
                continue
            here = (codes[: len(doc)] != 0) & (codes[n - 1 : n - 1 + len(doc)] != 0)  # texts are parted by zeros
            rows = (keys << np.uint64(of) | doc)[here]
            if len(wide):
                at = wide[here[wide]]
                lead = np.uint64(bits * (n - 1))
                led = np.uint64(1) << lead | keys[at] & ((np.uint64(1) << lead) - np.uint64(1))  # number 1 is HALF's
                rows = np.concatenate([rows, led << np.uint64(of) | doc[at]])
            if n * bits + of <= 32:
                rows = rows.astype(np.uint32)
            rows.sort()
            at = _starts(rows)
            kept = rows[at].astype(np.uint64)
            times = mult[(kept & np.uint64((1 << of) - 1)).astype(np.int64)]
            uses = np.diff(at, append=len(rows)) * times
            kept >>= np.uint64(of)
            at = _starts(kept)
            kept = kept[at]
            spread = np.zeros(len(kept), np.uint64)  # a character's number takes BITS bits from now on
            for j in range(n):
                spread |= (kept >> np.uint64(bits * j) & np.uint64((1 << bits) - 1)) << np.uint64(BITS * j)
            out[n] = spread, *((np.add.reduceat(x, at) if len(at) else x) for x in (uses, times))
        return out

    def _count(self):
        """The n-grams of the documents that wait, so many documents at a time as have a number in the key's free bits."""
        free = 64 - self.sizes[-1] * int(len(self.chars) - 1).bit_length()
        step = 1 << min(free, 32)
        for at in range(0, len(self.docs), step):
            for n, found in self._grams(self.docs[at : at + step], self.mults[at : at + step]).items():
                self.new[n].append(found)
        self.docs, self.mults, self.waiting = [], [], 0

    def _merge(self):
        for n in self.sizes:
            self.held[n] = _sums(*(np.concatenate(x) for x in zip(self.held[n], *self.new[n])))
            self.new[n] = []

    def totals(self):
        """Terms with their two frequencies, a part at a time; starts anew."""
        self._count()
        self._merge()
        for n in self.sizes:
            keys, tf, df = self.held[n]
            for i in range(0, len(keys), 200_000):
                part = keys[i : i + 200_000]
                yield self._terms(part, n), tf[i : i + 200_000], df[i : i + 200_000]
        self._start()


def _base(texts: DataFrame, id_col: str, text_col: str, mult_col: str | None) -> DataFrame:
    """(id, _t, mult) with the rows of an id next to each other in one task."""
    mult = F.col(mult_col).cast("bigint") if mult_col else F.lit(1).cast("bigint")
    base = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_t"), mult.alias("mult"))
    return base.where(F.col("_t").isNotNull()).repartition("id").sortWithinPartitions("id")


def _by_id(batches):
    """(id, mult, texts) of each run of equal ids."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for key, own in groupby(rows, key=lambda r: r[0]):
        first = next(own)
        yield key, first[2], chain([first[1]], (r[1] for r in own))


def term_totals(texts: DataFrame, id_col: str, text_col: str, mult_col: str | None = None,
                n_min: int = P.NGRAM_RANGE[0], n_max: int = P.NGRAM_RANGE[1]) -> DataFrame:
    """(term, tf, df) of every distinct n-gram of the corpus (whole texts, lower-cased; an id's rows are one document)."""
    schema = pa.schema([("term", pa.string()), ("tf", pa.int64()), ("df", pa.int64())])

    def run(batches):
        totals = _Totals(n_min, n_max)
        for _, mult, own in _by_id(batches):
            for part in totals.add(own, mult):
                yield pa.record_batch(list(part), schema=schema)
        for part in totals.totals():
            yield pa.record_batch(list(part), schema=schema)

    parts = _base(texts, id_col, text_col, mult_col).mapInArrow(run, "term string, tf long, df long")
    return parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


class _Vocabulary:
    """The vocabulary's terms as a tree of their characters (<= max_features terms, held on the driver and sent to every task).

    A character moves a node of one depth to one of the next; node 0 is no term's beginning, character 0 no term's."""

    def __init__(self, terms: dict[int, str], n_min: int, n_max: int):
        self.chars = np.unique(np.concatenate([np.array([HALF], np.uint32), *map(_points, terms.values())]))
        number = {chr(c): k for k, c in enumerate(self.chars.tolist(), 1)}
        self.half, self.width, self.moves, self.ranks = number[chr(HALF)], max(terms, default=0) + 1, [], []
        nodes = {"": 1}
        for depth in range(1, n_max + 1):
            below = {t: k for k, t in enumerate(sorted({t[:depth] for t in terms.values() if len(t) >= depth}), 1)}
            move = np.zeros((len(nodes) + 1, len(self.chars) + 1), np.min_scalar_type(len(below)))
            for t, k in below.items():
                move[nodes[t[:-1]], number[t[-1]]] = k
            rank = np.zeros(len(below) + 1, np.int64)
            for k, t in terms.items():
                if n_min <= len(t) == depth:
                    rank[below[t]] = k
            self.moves.append(move)
            self.ranks.append(rank)
            nodes = below

    def _number(self) -> np.ndarray:
        number = np.zeros(0x110000, np.int32)
        number[self.chars] = np.arange(1, len(self.chars) + 1)
        return number

    def _uses(self, codes: np.ndarray, wide: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """Uses by document and rank; ``codes`` ends with a zero for each further depth."""
        m, found = len(doc), []
        for at, lead in ((np.s_[:m], codes[:m]), (wide, np.full(len(wide), self.half))) if len(wide) else ((np.s_[:m], codes[:m]),):
            node, own = self.moves[0][1][lead], doc[at] * self.width
            place = None if isinstance(at, slice) else at
            for j, (move, rank) in enumerate(zip(self.moves, self.ranks)):
                if j:
                    then = codes[j : j + m] if place is None else codes[place + j]
                    node = move.ravel()[node * np.int64(move.shape[1]) + then]
                if rank.any():
                    ranks = rank[node]
                    found.append((own + ranks)[ranks > 0])
        return np.bincount(np.concatenate(found), minlength=docs * self.width) if found else np.zeros(docs * self.width, np.int64)

    def counted(self, batches):
        """(ids, row, rank, uses) of up to 1000 ids at a time, by row and rank."""
        number, depth = self._number(), len(self.moves)
        ids, total, held, of, size = [], np.zeros(0, np.int64), [], [], 0

        def add():
            docs = len(ids)
            points = np.concatenate([np.empty(0, np.uint32), *held])
            doc = np.repeat(np.array(of, np.int64), [len(p) for p in held])
            codes = np.concatenate([number[points], np.zeros(depth, np.int32)])
            codes[np.cumsum([0, *map(len, held)])[2::2] - 1] = 0
            uses = self._uses(codes, np.flatnonzero(points > 0xFFFF), doc, docs)
            uses[: len(total)] += total
            return uses

        gap = np.zeros(1, np.uint32)  # parts the texts
        for key, _, own in _by_id(batches):
            ids.append(key)
            full = len(ids) >= 1000
            for text in own:
                held += [_points(text), gap]
                of += [len(ids) - 1] * 2
                size += len(held[-2])
                if size >= TOGETHER:
                    total, held, of, size, full = add(), [], [], 0, True
            if full:
                yield ids, *self._entries(add())
                ids, total, held, of, size = [], np.zeros(0, np.int64), [], [], 0
        if ids:
            yield ids, *self._entries(add())

    def _entries(self, total: np.ndarray):
        at = np.flatnonzero(total)
        return at // self.width, at % self.width, total[at]


def _arrays(row: np.ndarray, n_rows: int, parts: pa.Array) -> pa.ListArray:
    """A list of ``parts`` for each of ``n_rows`` rows; ``row`` ascends."""
    ends = np.cumsum([0, *np.bincount(row, minlength=n_rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), parts)


def term_vectors(texts: DataFrame, vocab: DataFrame, id_col: str, text_col: str,
                 n_min: int = P.NGRAM_RANGE[0], n_max: int = P.NGRAM_RANGE[1]) -> DataFrame:
    """(id, v): for every id the vocabulary's terms in its texts, an array of (rank, cnt) by rank.

    ``vocab`` is a bounded table, as ``vocabulary`` gives it, and goes to every task.
    """
    known = _Vocabulary({r["rank"]: r["term"] for r in vocab.select("rank", "term").collect()}, n_min, n_max)
    base = _base(texts, id_col, text_col, None)
    id_type = base.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(id_type)), ("v", pa.list_(pa.struct([("rank", pa.int32()), ("cnt", pa.int64())])))])

    def run(batches):
        for ids, row, rank, uses in known.counted(batches):
            flat = pa.StructArray.from_arrays([pa.array(rank, pa.int32()), pa.array(uses, pa.int64())], ["rank", "cnt"])
            yield pa.record_batch([pa.array(ids, schema[0].type), _arrays(row, len(ids), flat)], schema=schema)

    return base.mapInArrow(run, f"id {id_type.simpleString()}, v array<struct<rank: int, cnt: bigint>>")


def ngram_counts(texts: DataFrame, id_col: str, text_col: str, mult_col: str | None = None,
                 n_min: int = P.NGRAM_RANGE[0], n_max: int = P.NGRAM_RANGE[1]) -> DataFrame:
    """(id, term, cnt, mult) for every distinct n-gram of every text (whole text, lower-cased)."""
    mult = F.col(mult_col).cast("bigint") if mult_col else F.lit(1).cast("bigint")
    base = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("_t"), mult.alias("mult"))
    grams = (base.repartition("id")
             .select("id", "mult", F.explode(char_ngrams("_t", n_min, n_max)).alias("term")))
    return grams.groupBy("id", "term").agg(F.count(F.lit(1)).alias("cnt"), F.first("mult").alias("mult"))


def vocabulary(counts: DataFrame, max_features: int) -> DataFrame:
    """Top ``max_features`` terms by corpus frequency (ties: term asc) with document frequency.

    ``counts`` are ``term_totals`` or ``ngram_counts``.
    Output has at most ``max_features`` rows (a proven bound), with ``rank`` 1..V.
    """
    stats = counts
    if "cnt" in counts.columns:
        stats = counts.groupBy("term").agg(F.sum(F.col("cnt") * F.col("mult")).alias("tf"),
                                           F.sum("mult").alias("df"))
    top = stats.orderBy(F.desc("tf"), F.asc("term")).limit(max_features)
    w = Window.orderBy(F.desc("tf"), F.asc("term"))  # over <= max_features rows only
    return top.withColumn("rank", F.row_number().over(w))


def held(vocab: DataFrame) -> DataFrame:
    """The vocabulary as a small local table (<= max_features rows): it is counted once."""
    return vocab.sparkSession.createDataFrame(vocab.toArrow(), vocab.schema)  # from Arrow: no Python worker reads it


_VECTOR = pa.list_(pa.struct([("rank", pa.int32()), ("term", pa.string()), ("w", pa.float64())]))


class _Weights:
    """Smooth idf by rank, and the terms' names (<= max_features rows)."""

    def __init__(self, vocab: DataFrame, n_docs: int):
        known = vocab.select("rank", "term", "df").orderBy("rank").collect()
        self.names = pa.array([None, *(r["term"] for r in known)], pa.string())  # by rank
        self.idf = np.array([0.0, *(np.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0 for r in known)])

    def weigh(self, row: np.ndarray, n_rows: int, rank: np.ndarray, cnt: np.ndarray, top: int):
        """Rows, ranks and L2-normalised weights of the first ``top`` terms."""
        keep = rank <= top
        rank, cnt, row = rank[keep], cnt[keep], row[keep]
        w = cnt * self.idf[rank]
        return row, rank, w / np.sqrt(np.bincount(row, w * w, n_rows))[row]

    def vectors(self, row: np.ndarray, n_rows: int, rank: np.ndarray, w: np.ndarray) -> pa.ListArray:
        return _arrays(row, n_rows, pa.StructArray.from_arrays([pa.array(rank, pa.int32()), self.names.take(pa.array(rank)), pa.array(w)], ["rank", "term", "w"]))


def tfidf_vectors(vectors: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(id, v): L2-normalised smooth-idf weights of the vocabulary's terms, an array of (rank, term, w) by rank.

    ``vectors`` are ``term_vectors`` over this vocabulary or a larger one with the same ordering; ``n_docs`` is the
    corpus size.
    """
    weights = _Weights(vocab, n_docs)
    schema = pa.schema([("id", to_arrow_type(vectors.schema["id"].dataType)), ("v", _VECTOR)])

    def run(batches):
        for b in (whole.slice(i, 1000) for whole in batches for i in range(0, whole.num_rows, 1000)):
            flat = b.column("v").flatten()
            rank, cnt = (flat.field(k).to_numpy() for k in (0, 1))
            row = np.repeat(np.arange(len(b)), b.column("v").value_lengths().to_numpy())
            found = weights.weigh(row, len(b), rank, cnt, len(weights.idf) - 1)
            yield pa.record_batch([b.column("id").cast(schema[0].type), weights.vectors(found[0], len(b), *found[1:])], schema=schema)

    id_type = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"id {id_type}, v array<struct<rank: int, term: string, w: double>>")


def sums_and_ranks(texts: DataFrame, vocab: DataFrame, n_docs: int, top: int, id_col: str, text_col: str,
                   n_min: int = P.NGRAM_RANGE[0], n_max: int = P.NGRAM_RANGE[1]) -> DataFrame:
    """(id, s, rank, w) in one pass over the texts: ``s`` is ``row_sums`` of the ``tfidf_vectors`` of ``term_vectors`` over the
    vocabulary, ``rank`` and ``w`` are those vectors over its first ``top`` terms.  The counts never leave the task that made them."""
    weights = _Weights(vocab, n_docs)
    known = _Vocabulary({r["rank"]: r["term"] for r in vocab.select("rank", "term").collect()}, n_min, n_max)
    base = _base(texts, id_col, text_col, None)
    id_type = base.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(id_type)), ("s", pa.float64()), ("rank", pa.list_(pa.int32())), ("w", pa.list_(pa.float64()))])

    def run(batches):
        for ids, row, rank, cnt in known.counted(batches):
            n = len(ids)
            of, _, w = weights.weigh(row, n, rank, cnt, len(weights.idf) - 1)
            first, first_rank, first_w = weights.weigh(row, n, rank, cnt, top)
            yield pa.record_batch([pa.array(ids, schema[0].type), pa.array(np.bincount(of, w, n).astype(float)),
                                   _arrays(first, n, pa.array(first_rank, pa.int32())), _arrays(first, n, pa.array(first_w))], schema=schema)

    return base.mapInArrow(run, f"id {id_type.simpleString()}, s double, rank array<int>, w array<double>")


def named(vocab: DataFrame, rank: Column, w: Column, top: int) -> Column:
    """The vector of (rank, term, w) of ``sums_and_ranks``; the terms are a literal of at most ``top`` names."""
    names = F.array(*[F.lit(r["term"]) for r in vocab.where(F.col("rank") <= top).orderBy("rank").collect()] or [F.lit(None).cast("string")])
    return F.zip_with(rank, w, lambda r, x: F.struct(r.alias("rank"), F.get(names, r - 1).alias("term"), x.alias("w")))


def sums_and_vectors(texts: DataFrame, vocab: DataFrame, n_docs: int, top: int, id_col: str, text_col: str,
                     n_min: int = P.NGRAM_RANGE[0], n_max: int = P.NGRAM_RANGE[1]) -> DataFrame:
    """(id, s, v): ``sums_and_ranks`` with the vectors as arrays of (rank, term, w)."""
    found = sums_and_ranks(texts, vocab, n_docs, top, id_col, text_col, n_min, n_max)
    return found.select("id", "s", named(vocab, F.col("rank"), F.col("w"), top).alias("v"))


def tfidf_weights(vectors: DataFrame) -> DataFrame:
    """(id, term, rank, w) of ``tfidf_vectors``, a row per term."""
    return vectors.select("id", F.explode("v").alias("x")).select("id", "x.term", "x.rank", "x.w")


def row_sums(vectors: DataFrame) -> DataFrame:
    """J8 input: (id, s) = sum of a row's normalised weights."""
    return vectors.select("id", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"]).alias("s"))


def minmax_hotness(ids: DataFrame, sums: DataFrame) -> DataFrame:
    """hotness = min-max of row sums over all ids (0 for rows without terms); 0.5 when flat.

    ``np.isclose(max, min)`` -> |max-min| <= 1e-8 + 1e-5 |min|.
    """
    s = ids.join(sums, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("s"))
    mm = s.select(F.struct(F.min("s").alias("lo"), F.max("s").alias("hi"))).scalar()
    lo, hi = mm["lo"], mm["hi"]
    flat = F.abs(hi - lo) <= (F.lit(1e-8) + F.lit(1e-5) * F.abs(lo))
    return s.select("id", F.when(flat, 0.5).otherwise((F.col("s") - lo) / (hi - lo + 1e-8)).alias("hotness"))


def _flat(batch: pa.RecordBatch):
    """Row, rank and weight of every entry of a batch (.., rank array, w array)."""
    ranks = batch.column("rank")
    return np.repeat(np.arange(len(batch)), ranks.value_lengths().to_numpy()), ranks.flatten().to_numpy(), batch.column("w").flatten().to_numpy()


def centroid_similarity(ids: DataFrame, vectors: DataFrame) -> DataFrame:
    """J10 on sparse rows: cosine of each row with the mean row, mapped (s+1)/2 and clipped;
    a single row scores 1.  Norms carry the +1e-8 guard (J9).

    Sums by rank are made per task; the mean row (<= V numbers) goes to every task.  ``vectors`` are (id, v), or (id, rank, w)."""
    parts = vectors.select("id", F.col("v.rank").alias("rank"), F.col("v.w").alias("w")) if "v" in vectors.columns else vectors
    n = ids.count()

    def sums(batches):
        total = np.zeros(0)
        for b in batches:
            _, rank, w = _flat(b)
            own = np.bincount(rank, w, len(total)).astype(float)  # whole numbers when there is no entry
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at].astype(float))], names=["rank", "c"])

    found = parts.select("rank", "w").mapInArrow(sums, "rank int, c double").groupBy("rank").agg(F.sum("c").alias("c")).collect()  # <= V rows
    mean = np.zeros(max((r["rank"] for r in found), default=0) + 1)
    for r in found:
        mean[r["rank"]] = r["c"] / n
    cn = float(np.sqrt(mean @ mean))
    id_type = vectors.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(id_type)), ("sim", pa.float64())])

    def similar(batches):
        for b in batches:
            row, rank, w = _flat(b)
            rn = np.sqrt(np.bincount(row, w * w, len(b)))
            sim = np.bincount(row, w * mean[rank], len(b)) / ((rn + 1e-8) * (cn + 1e-8))
            yield pa.record_batch([b.column("id").cast(schema[0].type), pa.array(sim)], schema=schema)

    rows = parts.mapInArrow(similar, f"id {id_type.simpleString()}, sim double")
    sim = ids.join(rows, "id", "left").select("id", F.coalesce("sim", F.lit(0.0)).alias("sim"))
    score = F.least(F.greatest((F.col("sim") + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0))
    return sim.select("id", (F.lit(1.0) if n == 1 else score).alias("semantic_score"))


def dot(a, b):
    """Dense dot product of two equal-length array columns (JVM-side HOFs)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b):
    """Cosine of two dense vectors with the +1e-8 norm guards."""
    na = F.sqrt(dot(a, a))
    nb = F.sqrt(dot(b, b))
    return dot(a, b) / ((na + 1e-8) * (nb + 1e-8))


def mean_vector(df: DataFrame, vec: str, by: list[str] | None = None) -> DataFrame:
    """Element-wise mean vector (per group): posexplode + groupBy(pos) + ordered re-assembly.

    Partial aggregation keeps one accumulator per (group, position); the
    re-assembled array has the vector width (bounded), never a group's rows.
    """
    by = list(by or [])
    e = df.select(*by, F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    m = e.groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    g = m.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s")) if by else \
        m.agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_s"))
    return g.select(*by, F.transform("_s", lambda s: s["m"]).alias("centroid"))
