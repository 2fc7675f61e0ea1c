"""Language identification by interpolated Kneser-Ney character models.

A language's model predicts every letter of a word, and the word's end, from the letters before it.  All
learning documents are counted (distinct words first, so the text is walked once); continuation counts,
discounts and back-off weights are aggregations over the n-gram table.  It is stored as arrays sorted by n-gram
hash, in parts of bounded size, and a task scores each distinct word once.  The language with
the lowest cross-entropy a letter wins; a text that its own language's documents make unlikely is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import Out, batch, mix, rows, spark_schema, text_bytes
from shelfwise.llm.warc import file_system
from shelfwise.session import cut_lineage, durable_path

ORDER = 4
START, END = "\x02", "\x03"  # never letters
FLUSH_WORDS = 200_000  # distinct words a task counts before it hands n-grams on
CACHE_WORDS = 200_000
CACHE_CELLS = 1 << 23  # words times languages in the cache
PART_ENTRIES = 1 << 22  # n-grams of a language in a part of the model (12 bytes each, and 16 an n-gram)
PIECE_ENTRIES = 1 << 17  # of them in a task that builds the arrays
HELD_PARTS = 2
HELD_BYTES = 1 << 20  # text whose new words are scored at once
SCORE_CELLS = 1 << 22  # letters times languages
UNKNOWN = 1e-6  # share of a letter that no language has
LETTERS = re.compile(r"[^\W\d_]+")
NO_LANGUAGE = "und"

GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
HASHED = pa.schema([("homes", pa.list_(pa.int32())), ("piece", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("lang", pa.string()), ("share", pa.float64()), ("weight", pa.float64())])
PIECES = pa.schema([("piece", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("hashes", "sizes", "languages", "shares", "weights"))])
BUILT = pa.schema([("part", pa.int32()), *PIECES])


def word_matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(characters, word numbers): every word between its start marks and its end mark, one after another."""
    text = "".join(START * (ORDER - 1) + w + END for w in words)
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    return chars, np.repeat(np.arange(len(words)), sizes)


def gram_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """For n = 1..ORDER the hash of the n characters that end at each place (wrong at the first n - 1 places of the array)."""
    out = [mix(chars + np.uint64(0x9E3779B97F4A7C15))]
    for n in range(1, ORDER):
        longer = np.zeros_like(chars)
        longer[1:] = out[-1][:-1]
        out.append(mix(longer * np.uint64(0xD6E8FEB86659FD93) + chars + np.uint64(n)))
    return out


def hash_of(gram: str) -> int:
    """The hash that gram_hashes gives a text of its own."""
    return int(gram_hashes(np.array([ord(c) for c in gram], np.uint64))[len(gram) - 1][-1])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counted in tokens.items():
            words: Counter = Counter()
            for token, n in counted.items():
                for w in LETTERS.findall(token):
                    words[w] += n
            if not words:
                continue
            chars, of = word_matrix(list(words))
            weight = np.fromiter(words.values(), np.int64, len(words))[of]
            ends = np.flatnonzero(chars != ord(START))
            hashes, first, back = np.unique(gram_hashes(chars)[ORDER - 1][ends], return_index=True, return_inverse=True)
            n = np.bincount(back, weight[ends], len(hashes)).astype(np.int64)
            at = ends[first][:, None] + np.arange(1 - ORDER, 1)
            text = chars[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            grams = [text[i:i + ORDER] for i in range(0, len(text), ORDER)]
            yield batch(GRAMS, [[lang] * len(grams), grams, n])
        tokens.clear()

    for lang, raw in rows(batches, "lang", "text"):
        counted = tokens.get(lang)
        if counted is None:
            counted = tokens[lang] = Counter()
        counted.update(raw.decode("utf-8", "replace").lower().split())
        if len(counted) > FLUSH_WORDS:
            yield from flush()
    yield from flush()


@dataclass(frozen=True)
class Part:
    """Of n-grams, n = 1..ORDER: sorted hashes, where the entries of each begin, and the entries' language, share and weight as a context."""

    hashes: tuple[np.ndarray, ...]
    starts: tuple[np.ndarray, ...]
    languages: tuple[np.ndarray, ...]
    shares: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]

    def entries(self, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``wanted``, entry numbers) of all entries of the n-grams with these hashes."""
        if len(self.hashes[n]) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hashes[n], wanted), len(self.hashes[n]) - 1)
        hit = np.flatnonzero(self.hashes[n][at] == wanted)
        first, size = self.starts[n][at[hit]], np.diff(self.starts[n])[at[hit]]
        before = np.cumsum(size) - size
        return np.repeat(hit, size), np.arange(size.sum()) + np.repeat(first - before, size)


def part_of(table: pa.Table) -> Part:
    """The Part whose pieces, ranges of hashes, are the rows of PIECES."""
    got = sorted(table.to_pylist(), key=lambda r: r["piece"])
    pieces = [[r for r in got if r["n"] == n] for n in range(1, ORDER + 1)]

    def joined(name: str, kind: str) -> tuple[np.ndarray, ...]:
        return tuple(np.frombuffer(b"".join(r[name] for r in own), kind) for own in pieces)

    sizes = joined("sizes", "<i4")
    return Part(joined("hashes", "<u8"), tuple(np.append(0, np.cumsum(x)).astype(np.int64) for x in sizes), joined("languages", "<u4"), joined("shares", "<f4"), joined("weights", "<f4"))


@dataclass(frozen=True)
class Model:
    """The n-grams of all languages, in ``parts`` parts by the letter before the last one.

    A letter's probability needs n-grams that end with it and contexts that end with the letter before it, so one part has all of
    them.  ``held`` are the first parts, a few of bounded size; tasks read the others from ``path``.
    """

    languages: tuple[str, ...]
    parts: int
    held: tuple[Part, ...]
    path: str
    floor: np.ndarray  # share of a character below all orders

    def part(self, i: int) -> Part:
        if i < len(self.held):
            return self.held[i]
        from pyarrow import parquet

        system, at = file_system(f"{self.path}/part={i}")
        files = [f for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.path.endswith(".parquet")]
        return part_of(pa.concat_tables([parquet.ParquetFile(system.open_input_file(f.path)).read() for f in files] or [PIECES.empty_table()]))

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(negative log likelihood per word and language, predicted characters per word)."""
        chars, of = word_matrix(words)
        hashes = gram_hashes(chars)
        ends = np.flatnonzero(chars != ord(START))
        word = of[ends]
        # the longest n-gram has all shorter ones and contexts in it, so each different one is looked up once
        _, first, back = np.unique(hashes[ORDER - 1][ends], return_index=True, return_inverse=True)
        different = ends[first]
        total = np.zeros((len(words), len(self.languages)))
        home = chars[different - 1] % np.uint64(self.parts)
        most = max(1, SCORE_CELLS // len(self.languages))
        for i in np.unique(home).tolist():
            part, mine = self.part(i), np.flatnonzero(home == i)
            for lo in range(0, len(mine), most):
                grams = mine[lo:lo + most]
                at = different[grams]
                p = np.tile(self.floor, (len(at), 1))
                for n in range(ORDER):
                    if n:  # the context is the shorter n-gram that ends a place earlier
                        place, entry = part.entries(n - 1, hashes[n - 1][at - 1])
                        p[place, part.languages[n - 1][entry]] *= part.weights[n - 1][entry]
                    place, entry = part.entries(n, hashes[n][at])
                    p[place, part.languages[n][entry]] += part.shares[n][entry]
                nats = -np.log(np.maximum(p, 1e-12))
                row = np.full(len(different), -1)
                row[grams] = np.arange(len(grams))
                letters = row[back]
                places = np.flatnonzero(letters >= 0)
                for begin in range(0, len(places), most):
                    some = places[begin:begin + most]
                    new = np.flatnonzero(np.append(True, np.diff(word[some]) != 0))
                    total[word[some[new]]] += np.add.reduceat(nats[letters[some]], new, axis=0)
        return total, np.bincount(word, minlength=len(words))


def _hash(pieces: int):
    """Entries with the hash of their n-gram, and the range of hashes that it lies in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for n in range(1, ORDER + 1):
                own = got.filter(pc.equal(got["n"], n))
                if own.num_rows == 0:
                    continue
                text = b"".join(own["gram"].cast(pa.binary()).to_pylist()).decode("utf-8", "surrogatepass")
                h = _hash_rows(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(-1, n))
                piece = (h >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
                columns = [own["homes"], pa.array(piece.astype(np.int32)), own["n"], pa.array(h.view(np.int64)), *(own[c] for c in ("lang", "share", "weight"))]
                yield pa.RecordBatch.from_arrays(columns, schema=HASHED)
    return run


def _build(number: dict[str, int]):
    """The entries of a piece as sorted arrays, a row for each n."""
    def run(table: pa.Table) -> pa.Table:
        out = []
        for n in range(1, ORDER + 1):
            own = table.filter(pc.equal(table["n"], n)).combine_chunks()
            if own.num_rows == 0:
                continue
            lang = np.array([number[x] for x in own["lang"].to_pylist()], "<u4")
            h = own["hash"].to_numpy().view(np.uint64)
            order = np.lexsort((lang, h))
            h = h[order]
            new = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            share, weight = (own[c].to_numpy().astype("<f4")[order] for c in ("share", "weight"))
            sizes = np.diff(np.append(new, len(h))).astype("<i4")
            out.append((own["part"][0].as_py(), own["piece"][0].as_py(), n, *(x.tobytes() for x in (h[new], sizes, lang[order], share, weight))))
        return pa.Table.from_batches([batch(BUILT, list(zip(*out)))], BUILT)
    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn one model per language from every row whose language is not null.

    The model has every n-gram of the learning documents.  Up to ``HELD_PARTS`` parts of about ``PART_ENTRIES`` entries (n-gram and
    language) travel with the tasks; the rest stays in the shared folder and is read by the tasks part by part.
    """
    spark = docs.sparkSession
    learn = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_bytes(text_col).alias("text"))
    top = cut_lineage(learn.mapInArrow(_count, spark_schema(GRAMS)).groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    levels = [top]
    for _ in range(ORDER - 1):  # in how many ways a shorter n-gram continues a character
        levels.append(levels[-1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    grams = levels[0]
    for level in levels[1:]:
        grams = grams.unionByName(level)
    size = F.length("gram")
    grams = cut_lineage(grams.withColumn("size", size).withColumn("context", F.expr("substring(gram, 1, size - 1)")))
    discounts = grams.groupBy("lang", "size").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"))
    discounts = discounts.select("lang", "size", F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.coalesce(
        F.try_divide(F.col("ones"), F.col("ones") + 2 * F.col("twos")), F.lit(0.5)))).alias("d"))
    contexts = grams.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types")).join(discounts, ["lang", "size"])
    contexts = cut_lineage(contexts.withColumn("weight", F.col("d") * F.col("types") / F.col("total")))
    shares = grams.join(contexts, ["lang", "size", "context"]).select(
        F.col("size").alias("n"), "gram", "lang", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"), F.lit(None).cast("double").alias("weight"))
    weights = contexts.where("size > 1").select((F.col("size") - 1).alias("n"), F.col("context").alias("gram"), "lang", F.lit(None).cast("double").alias("share"), "weight")
    entries = cut_lineage(shares.unionByName(weights).groupBy("n", "gram", "lang").agg(
        F.coalesce(F.max("share"), F.lit(0.0)).alias("share"), F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight")))

    lowest = {r.lang: r.weight for r in contexts.where("size = 1").select("lang", "weight").collect()}
    languages = tuple(sorted(lowest))
    letters = max(1, grams.where("size = 1").select("gram").distinct().count())
    floor = np.array([max(UNKNOWN, lowest[lang] / letters) for lang in languages])
    found = entries.count()
    parts, pieces = max(1, -(-found // PART_ENTRIES)), max(1, -(-min(found, PART_ENTRIES) // PIECE_ENTRIES))
    # an entry serves as n-gram where its letter before the last one says, and as context where its last one does
    last, before = (F.ascii(F.expr(f"substring(gram, -{i}, 1)")) % parts for i in (1, 2))
    homes = F.when(F.col("n") == 1, F.sequence(F.lit(0), F.lit(parts - 1))).when(F.col("n") == ORDER, F.array(before)).otherwise(F.array_distinct(F.array(last, before)))
    path = durable_path(spark, "language")
    hashed = entries.withColumn("homes", homes).mapInArrow(_hash(pieces), spark_schema(HASHED)).withColumn("part", F.explode("homes")).drop("homes")
    built = hashed.groupBy("part", "piece").applyInArrow(_build({lang: i for i, lang in enumerate(languages)}), spark_schema(BUILT))
    built.write.partitionBy("part").parquet(path)
    held = min(parts, HELD_PARTS) if languages else 0
    stored = spark.read.schema(spark_schema(BUILT)).parquet(path) if held else None
    return Model(languages, parts, tuple(part_of(stored.where(F.col("part") == i).drop("part").toArrow()) for i in range(held)), path, floor)


def _hash_rows(chars: np.ndarray) -> np.ndarray:
    """gram_hashes of every row taken for itself."""
    out = mix(chars[:, 0] + np.uint64(0x9E3779B97F4A7C15))
    for n in range(1, chars.shape[1]):
        # the hash of the first n characters followed by the next
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + chars[:, n] + np.uint64(n))
    return out


def _score(schema: pa.Schema, model: Model):
    n_lang = len(model.languages)
    most_words = min(CACHE_WORDS, CACHE_CELLS // max(1, n_lang))
    # parts that are read again for every lot of words are read for larger lots
    most_bytes = HELD_BYTES * (1 if model.parts <= len(model.held) else 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: dict[str, int] = {}
        nats, letters = np.zeros((0, n_lang)), np.zeros(0, np.int64)
        out = Out(schema)

        def learn(new: list[str]) -> None:
            nonlocal nats, letters
            if len(tokens) > most_words:
                tokens.clear()
                nats, letters = nats[:0], letters[:0]
            found = [LETTERS.findall(t) for t in new]
            words = list(dict.fromkeys(w for f in found for w in f))
            more, size = np.zeros((len(new), n_lang)), np.zeros(len(new), np.int64)
            if words and n_lang:
                scores, chars = model.word_scores(words)
                place = {w: i for i, w in enumerate(words)}
                flat = np.array([place[w] for f in found for w in f], np.int64)
                of = np.repeat(np.arange(len(new)), [len(f) for f in found])
                for j in range(n_lang):
                    more[:, j] = np.bincount(of, scores[flat, j], len(new))
                size = np.bincount(of, chars[flat], len(new)).astype(np.int64)
            elif words:
                size = np.array([sum(map(len, f)) for f in found])
            tokens.update(zip(new, range(len(letters), len(letters) + len(new))))
            nats, letters = np.concatenate([nats, more]), np.concatenate([letters, size])

        def scored(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            split = [raw.decode("utf-8", "replace").lower().split() for _, raw in held]
            if len(tokens) > most_words:
                tokens.clear()
                learn([])
            learn(list({t for s in split for t in s if t not in tokens}))
            for (key, _), s in zip(held, split):
                ids = np.fromiter(map(tokens.__getitem__, s), np.int64, len(s))
                size = int(letters[ids].sum())
                if size == 0 or n_lang == 0:
                    full = out.add(key, NO_LANGUAGE, 0.0, None)
                else:
                    entropy = nats[ids].sum(axis=0) / size
                    best = int(entropy.argmin())
                    odds = np.exp((entropy[best] - entropy) * min(size, 60))
                    full = out.add(key, model.languages[best], float(1 / odds.sum()), float(entropy[best]))
                if full:
                    yield out.take()

        held, size = [], 0
        for row in rows(batches, "doc_id", "text"):
            held.append(row)
            size += len(row[1])
            if size > most_bytes:
                yield from scored(held)
                held, size = [], 0
        yield from scored(held)
        yield out.take()
    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy) of every whole text; ``und`` with score 0 where it is null or has no letter.

    ``score`` is the winner's share when the cross-entropies of at most 60 letters compete.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    named = docs.select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = pa.schema([("doc_id", to_arrow_type(named.schema["doc_id"].dataType)), ("lang_pred", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64())])
    return named.mapInArrow(_score(schema, model), spark_schema(schema))


def reject(scored: DataFrame, known: Column, share: float = 0.995) -> DataFrame:
    """``scored`` with ``rejected``: the cross-entropy is above what ``share`` of the rows that are ``known`` to be of this language have."""
    limits = scored.where(known & F.col("cross_entropy").isNotNull()).groupBy("lang_pred").agg(F.percentile_approx("cross_entropy", F.lit(share), F.lit(10_000)).alias("limit"))
    return scored.join(F.broadcast(limits), "lang_pred", "left").withColumn(
        "rejected", F.coalesce(F.col("cross_entropy") > F.col("limit"), F.col("lang_pred") == NO_LANGUAGE)).drop("limit")
