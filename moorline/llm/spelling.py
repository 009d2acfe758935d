"""Spelling variants: words one edit apart, found through an index of variable-length grams.

Words are maximal runs of letters (Latin-1's among them), lower-cased in A-Z alone. Each
distinct word of ``shortest`` code points and ``least`` occurrences is compared with all others:

1. **Gram dictionary.** Every gram of ``q_min`` to ``q_max`` code points of the words (with a
   mark before and one after) is counted. A gram of more than ``frequent`` places is pruned
   from the dictionary in favour of its longer grams, so common letters give long grams and
   rare ones short grams; no gram of the dictionary begins another.
2. **Decomposition.** At each place of a word begins exactly one gram of the dictionary. Which
   one depends on that gram's own letters alone, so an edit changes only the grams that hold
   its place.
3. **Affected grams.** ``affected`` is the largest number of a word's grams that one place lies
   in. A near word shares all but those, so it shares one of the ``affected + 1`` rarest. As
   ``q_max`` is at most ``shortest``, a place of an edit never lies in all grams: the first
   gram ends before the last letter, and the last begins after all others. No word needs a scan.
4. **Merging.** The lists of these rarest grams are merged by an equi-join on gram, place and
   length (same length and place, or one longer and at most one further), and each pair that
   meets is verified by its edit distance on the spot; only verified pairs are shuffled.

A word over ``whole`` code points is indexed by its first and last half of ``whole`` instead:
one edit leaves one of them as it is.

Null text has no words and a null id is written as nothing before the colon. Repeated rows
count as often as they stand. Ties go to the smallest word in code-point order. Texts are
read in pieces, so a very long one needs no more memory than its longest run of letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moorline.llm.shared import cut

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@dataclass(frozen=True)
class Params:
    shortest: int = 5  #: code points of a word, at least
    least: int = 3  #: occurrences of a word, at least
    slips: int = 97  #: a run whose hash with its document's id divides by this loses a letter
    ratio: int = 2  #: a form occurs at least so many times as often as its word
    q_min: int = 2
    q_max: int = 5  #: at most ``shortest``
    frequent: int = 1000  #: places beyond which a gram is replaced by longer ones
    whole: int = 256  #: code points beyond which a word is indexed by its two ends
    most_broadcast: int = 500_000  #: frequent grams sent to every task; more are joined by a shuffle
    piece: int = 1 << 20  #: characters of a text read at once
    held: int = 300_000  #: distinct words counted in a task before they are sent on


def pieces(text: str, size: int) -> Iterator[str]:
    """The text in pieces that end between runs."""
    at = 0
    while len(text) - at > size:
        end = GAP.search(text, at + size)
        if end is None:
            break
        yield text[at : end.start()]
        at = end.start()
    yield text[at:] if at else text


def slipped(doc_id: object, run: str, slips: int) -> str:
    """A lower-cased run as its document spells it."""
    h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces(text.as_py() or "", p.piece):
                    for run, n in Counter(LETTERS.findall(piece)).items():
                        word = slipped(doc_id, run.lower() if run.isascii() else run.translate(CAPITALS), p.slips)
                        if len(word) >= p.shortest:
                            held[word] += n
                    if len(held) > p.held:
                        yield out()
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= p.least)


def marked(word: str) -> str:
    return f"^{word}$"


def frequent_grams(words: DataFrame, p: Params = Params()) -> DataFrame:
    """(gram, places) of the grams that the dictionary leaves out for longer ones, and of those of full length that are as frequent."""
    w = words.where(F.length("word") <= p.whole).select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    at = w.select("w", F.explode(F.sequence(F.lit(1), F.length("w") - F.lit(p.q_min - 1))).alias("at"))
    lengths = F.sequence(F.lit(p.q_min), F.least(F.lit(p.q_max), F.length("w") - F.col("at") + 1))
    grams = at.select(F.explode(F.transform(lengths, lambda n: F.substring("w", F.col("at"), n))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > p.frequent)


def decompose(word: str, places: Callable[[int, int], int], p: Params = Params()) -> list[tuple[int, str, int]]:
    """(place, gram, places of the gram if frequent, else 0) for each place; ``places(at, length)`` looks a gram up."""
    w, out = marked(word), []
    for at in range(len(w) - p.q_min + 1):
        n = p.q_min
        while (found := places(at, n)) and n < p.q_max and at + n < len(w):
            n += 1
        out.append((at, w[at : at + n], found))
    return out


def affected(grams: list[tuple[int, str, int]]) -> int:
    """The most grams that hold one place between the two marks."""
    last = grams[-1][0] + len(grams[-1][1]) - 1
    begins, ends = [0] * (last + 2), [0] * (last + 2)
    for at, gram, _ in grams:
        begins[at] += 1
        ends[at + len(gram)] += 1
    most = here = 0
    for i in range(last + 1):
        here += begins[i] - ends[i]
        if i:
            most = max(most, here)
    return most


def indexed(word: str, places: Callable[[int, int], int], p: Params = Params()) -> list[tuple[int, str]]:
    """(place, gram) of the lists that a word is to be found in."""
    out = []
    if len(word) <= p.whole:
        grams = decompose(word, places, p)
        # The rarest first, by an order that is the same for every word.
        ranked = sorted(grams, key=lambda g: (g[2], -len(g[1]), g[1], g[0]))
        out += [(at, gram) for at, gram, _ in ranked[: affected(grams) + 1]]
    if len(word) >= p.whole:
        half = p.whole // 2
        out += [(0, "<" + word[:half]), (0, ">" + word[-half:])]
    return out


def index(words: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n, at, gram): the lists of each word's rarest grams."""
    frequent = cut(frequent_grams(words, p), "grams")
    if frequent.count() <= p.most_broadcast:
        sent = words.sparkSession.sparkContext.broadcast({r.gram: r.places for r in frequent.collect()})
        given = words.withColumn("found", F.lit(None).cast("array<struct<at:int,length:int,places:long>>"))
    else:
        sent = None
        w = words.where(F.length("word") <= p.whole).select("word", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
        at = w.select("word", "w", F.explode(F.sequence(F.lit(1), F.length("w") - F.lit(p.q_min - 1))).alias("at"))
        at = at.select("word", "w", "at", F.explode(F.sequence(F.lit(p.q_min), F.least(F.lit(p.q_max), F.length("w") - F.col("at") + 1))).alias("length"))
        hits = at.withColumn("gram", F.substring("w", F.col("at"), F.col("length"))).join(frequent, "gram")
        found = hits.groupBy("word").agg(F.collect_list(F.struct((F.col("at") - 1).cast("int").alias("at"), F.col("length").cast("int").alias("length"), "places")).alias("found"))
        given = words.join(found, "word", "left")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"word": [], "n": [], "at": [], "gram": []}
            for word, n, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if sent is not None:
                    w, known = marked(word), sent.value
                    look = lambda at, length, w=w, known=known: known.get(w[at : at + length], 0)
                else:
                    own = {(x["at"], x["length"]): x["places"] for x in found or ()}
                    look = lambda at, length, own=own: own.get((at, length), 0)
                for at, gram in indexed(word, look, p):
                    for name, value in (("word", word), ("n", n), ("at", at), ("gram", gram)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["word"], pa.string()), pa.array(out["n"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["gram"], pa.string())], names=list(out))

    return given.select("word", "n", "found").mapInArrow(listed, "word string, n long, at int, gram string")


def near_words(lists: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one edit apart once, whatever number of lists they share."""
    place = lambda at, length: F.xxhash64("gram", at.cast("int"), length.cast("int"))
    at, length = F.col("at"), F.length("word")
    left = lists.select(place(at, length).alias("list"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    probes: Column = F.array(place(at, length), place(at, length + 1), place(at + 1, length + 1))
    right = lists.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(probes).alias("list"))
    shorter_first = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    pairs = right.join(left, (right["list"] == left["list"]) & shorter_first & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms are followed to the last by doubling.

    Each form occurs more often than its word, so there is no ring; a chain of n forms takes about log n rounds.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``docs(doc_id, text)``.

    ``form`` is the near word of most occurrences if it has ``ratio`` times the word's, else null;
    ``root`` is the last word that forms lead to, the word itself if it has none.
    """
    words = cut(count_words(docs, p), "words")
    pairs = near_words(index(words, p))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("near")).alias("best")), F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("n"), F.col("a").alias("near")).alias("best"))))
    near = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    rows = words.join(near, "word", "left")
    formed = -F.col("best.n") >= p.ratio * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.n")).alias("form_n")), "near")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
