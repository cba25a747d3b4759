"""Exact substring search of many phrases in many texts by q-grams.

Texts are arrays of pieces (cut at single blanks). A phrase without a blank can only lie
inside a piece; a phrase ``a m1 .. b`` is a run of pieces whose first ends with ``a``, whose
middle is equal and whose last begins with ``b``.

* Phrases without a blank are looked up in the distinct pieces, each by its rarest q-gram
  in the texts alone, and then compared exactly (:func:`contained`).
* Any other phrase is looked up by a q-gram across a blank: the last characters of one piece
  and the first of the next, as many as it has up to ``Q`` on each side, at its rarest blank.
  A position of a text gives at most ``(Q + 1) ** 2`` such grams, whatever its pieces are.
  What meets is compared exactly; runs of three and more pieces are compared in the text's
  own array of pieces, at the positions that met, so a long phrase widens no others.

  Positions none of whose grams has its bit set in a bitmap of the phrases' grams (of bounded size, one
  bit a gram) are left out before any row is multiplied.

Nothing is limited: short parts use shorter grams, and more grams only set more of the bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.session import materialise, own_exchange, small_side

Q = 3
GRAM_BITS = 256  # bits of the bitmap for each gram
MAX_WORDS = 1 << 20  # of 64 bits: 8 MB at most


def _grams(text, size):
    """Distinct runs of ``size`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))


def contained(phrases: DataFrame, vocabulary: DataFrame, q: int = Q) -> DataFrame:
    """``(phrase, piece)`` for ``phrases`` (phrase, distinct, not empty) and ``vocabulary`` (piece, times)."""
    sized = phrases.select("phrase", F.least(F.length("phrase"), F.lit(q)).alias("size"))
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect())  # 1 .. q
    if not sizes:
        return phrases.select("phrase", F.lit("").alias("piece"))  # no phrase, no row
    of_phrase = sized.select("phrase", F.explode(_grams(F.col("phrase"), F.col("size"))).alias("gram"))
    of_piece = (vocabulary.select("piece", "times", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
                .where(F.length("piece") >= F.col("size"))
                .select("piece", "times", F.explode(_grams(F.col("piece"), F.col("size"))).alias("gram")))
    often = of_piece.join(own_exchange(of_phrase.select("gram").distinct()), "gram") \
        .groupBy("gram").agg(F.sum("times").alias("often"))
    keys = (of_phrase.join(own_exchange(often), "gram", "left").groupBy("phrase")
            .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram")).alias("rarest"))
            .where("rarest.often > 0").select("phrase", F.col("rarest.gram").alias("gram")))
    return of_piece.join(own_exchange(keys), "gram").where(F.contains("piece", "phrase")).select("phrase", "piece")


class PhraseSearch:
    """Pieces and runs of pieces that hold the phrases.

    ``texts``: ``id_col`` and ``pieces`` (array of strings); ``phrases``: strings, empty ones
    and repeats do not count. Texts of one id are told apart by their hash.
    """

    def __init__(self, texts: DataFrame, phrases: DataFrame, phrase_col: str, id_col: str = "doc_id", q: int = Q):
        self.id_col, self.q = id_col, q
        self.texts = texts.select(id_col, "pieces", F.xxhash64("pieces").alias("_text"))
        p = materialise(phrases.select(F.col(phrase_col).alias("phrase")).where(F.length("phrase") > 0).distinct(), "phrases")
        self.single = p.where(~F.contains("phrase", F.lit(" ")))
        self.runs = p.where(F.contains("phrase", F.lit(" ")))

    def in_pieces(self) -> DataFrame:
        """``(id, piece, times, phrase)``: phrases without a blank in the pieces of each text."""
        if self.single.isEmpty():  # nothing to look up in the pieces
            return self.single.sparkSession.createDataFrame(
                [], f"{self.id_col} {dict(self.texts.dtypes)[self.id_col]}, piece string, times bigint, phrase string")
        counts = self.texts.select(self.id_col, F.explode("pieces").alias("piece")) \
            .groupBy(self.id_col, "piece").agg(F.count(F.lit(1)).alias("times"))
        found = contained(self.single, counts.groupBy("piece").agg(F.sum("times").alias("times")), self.q)
        return counts.join(own_exchange(found), "piece").select(self.id_col, "piece", "times", "phrase")

    def crossings(self) -> DataFrame:
        """``(phrase, k, back, gram)``: the grams across every blank of the phrases; ``back`` counts from the run's start."""
        at = self.runs.select("phrase", F.split("phrase", " ").alias("kp")).select(
            "phrase", F.size("kp").alias("k"), F.expr("explode(transform(sequence(1, size(kp) - 1), i -> named_struct("
                                                      "'back', i - 1, 'left', kp[i - 1], 'right', kp[i])))").alias("c"))
        gram = F.concat(F.expr(f"right(c.left, {self.q})"), F.lit(" "), F.expr(f"left(c.right, {self.q})"))
        return at.select("phrase", "k", F.col("c.back").alias("back"), gram.alias("gram"))

    @staticmethod
    def _bitmap(crossings: DataFrame) -> tuple[DataFrame, int]:
        """``(word, w)``: the words of 64 bits in which a bit of a gram's hash is set; and the number of bits."""
        n = crossings.count() * GRAM_BITS // 64
        words = min(MAX_WORDS, 1 << max(n, 1).bit_length())
        bit = F.pmod(F.xxhash64(F.substring_index("gram", " ", 1), F.substring_index("gram", " ", -1)), F.lit(64 * words))
        used = crossings.select(F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("at"))
        return used.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, at))").alias("w")), 64 * words

    def _positions(self, shapes, crossings: DataFrame | None = None) -> DataFrame:
        """One row for each blank of each text and each of the shapes (characters before, after); with ``crossings``
        only those whose gram may be one of theirs."""
        pair = F.expr("element_at(transform(array(pieces), t -> transform(sequence(1, size(t) - 1), i -> "
                      "named_struct('at', i - 1, 'first', t[i - 1], 'next', t[i]))), 1)")
        rows = self.texts.where(F.size("pieces") > 1).select(self.id_col, "_text", F.explode(pair).alias("p")) \
            .select(self.id_col, "_text", "p.*")
        columns = rows.columns
        # the shapes as rows: one small expression for all of them, which the JVM compiles
        each = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in shapes]))
        rows = rows.select("*", each.alias("s")).where((F.length("first") >= F.col("s.x")) & (F.length("next") >= F.col("s.y"))) \
            .select(*columns, F.expr("right(first, s.x)").alias("_b"), F.expr("left(next, s.y)").alias("_a"))
        if crossings is not None:
            bitmap, bits = self._bitmap(crossings)
            bit = F.pmod(F.xxhash64("_b", "_a"), F.lit(bits))
            rows = rows.select("*", F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int").alias("bit")) \
                .join(F.broadcast(bitmap), "word").where(F.getbit("w", "bit") == 1)  # at most MAX_WORDS rows
        return rows.select(*columns, F.concat("_b", F.lit(" "), "_a").alias("gram"))

    def phrase_runs(self) -> DataFrame:
        """``(id, phrase, k, pos, first, last, a, b)``: runs of ``k`` pieces from ``pos`` on that hold a phrase."""
        crossings = materialise(self.crossings(), "crossings")
        left, right = F.locate(" ", "gram") - 1, F.length("gram") - F.locate(" ", "gram")
        shapes = sorted(tuple(r) for r in crossings.select(left, right).distinct().collect())  # at most (q + 1) ** 2
        schema = f"{self.id_col} {dict(self.texts.dtypes)[self.id_col]}, phrase string, k int, pos int, first string, last string, a string, b string"
        if not shapes:
            return crossings.sparkSession.createDataFrame([], schema)
        rows = self._positions(shapes, crossings)
        a, b = F.substring_index("phrase", " ", 1).alias("a"), F.substring_index("phrase", " ", -1).alias("b")
        keys = crossings.where("k = 2").select("phrase", "k", "gram", a, b)
        out = (rows.join(small_side(keys, "keys"), "gram").where(F.endswith("first", "a") & F.startswith("next", "b"))
               .select(self.id_col, "phrase", "k", F.col("at").alias("pos"), "first", F.col("next").alias("last"), "a", "b"))
        longer = crossings.where("k > 2")
        if longer.isEmpty():
            return out
        often = rows.join(own_exchange(longer.select("gram").distinct()), "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
        rarest = (longer.join(own_exchange(often), "gram", "left").groupBy("phrase", "k")
                  .agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "back")).alias("key"))
                  .where("key.often > 0").select("phrase", "k", "key.gram", "key.back"))
        near = (rows.join(own_exchange(rarest), "gram").groupBy(self.id_col, "_text")
                .agg(F.collect_set(F.struct((F.col("at") - F.col("back")).alias("pos"), "phrase", "k")).alias("near"))
                .withColumnRenamed(self.id_col, "_id").withColumnRenamed("_text", "_hash"))
        met = self.texts.join(near, F.col(self.id_col).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
        found = met.select(self.id_col, F.explode(F.expr("""
            element_at(transform(array(pieces), t -> transform(
                filter(near, x -> x.pos >= 0 AND x.pos + x.k <= size(t)),
                x -> named_struct('pos', x.pos, 'phrase', x.phrase, 'k', x.k, 'first', t[x.pos], 'last', t[x.pos + x.k - 1],
                                  'mid', array_join(slice(t, x.pos + 2, x.k - 2), ' ')))), 1)""")).alias("r")) \
            .select(self.id_col, "r.*", a, b)
        middle = F.expr("substring(phrase, length(a) + 2, length(phrase) - length(a) - length(b) - 2)")
        return out.unionByName(found.where((F.col("mid") == middle) & F.endswith("first", "a") & F.startswith("last", "b"))
                               .select(out.columns))
