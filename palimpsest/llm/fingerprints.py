"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text's words (``[^\\x20\\x09-\\x0D]+``; of a word of more than ``PIECE`` characters its
pieces, so that texts without white space have anchors too) are named by a 64-bit
hash.  Of the runs of ``K`` words those are chosen whose least word name stands at
an edge: closed syncmers, whose choice depends on nothing outside of them, so
that a copied passage anchors the same runs wherever it stands.

The fingerprint holds the ``SKETCH`` least names of distinct syncmers, each of 8 hex
digits with 6 more that tell the place of its first word, so its size is bounded.
Two fingerprints are matched by position: of the anchors with a common name those
count that are displaced alike.  Anchors are sorted by place, and a step of
displacement from one common anchor to the next that is larger than ``SLACK`` words
breaks the match; the anchors of unbroken neighbours are what the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .order import successors

K, SKETCH, PIECE = 3, 64, 16
#: Words by which neighbouring common anchors may shift against each other.
SLACK = 8
_MARK = 16


def fingerprint(text: Column, sketch: int = SKETCH) -> Column:
    """Hex fingerprint, by ascending name; of fewer than K words all are one run; no words: an empty string."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^ \\t-\\r]{{1,{PIECE}}}"), F.lit(0))
    names = F.transform(words, lambda w: F.xxhash64(w))

    def anchor(h: Column, i: Column) -> Column:
        return F.struct(F.shiftrightunsigned(h, 32).alias("h"), i.alias("i"))

    def runs(h: Column) -> Column:
        def chosen(i: Column) -> Column:
            a, b, c = F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)
            return F.when(F.least(a, c) <= b, anchor(F.xxhash64(a, b, c), i))

        few = F.when(F.size(h) > 0, F.array(anchor(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
        return F.when(F.size(h) < K, few).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - K), chosen))

    def first_of_each(sorted_: Column) -> Column:
        return F.filter(sorted_, lambda x, k: (k == 0) | (F.get(sorted_, k - 1)["h"] != x["h"]))

    # each array is bound once, as a lambda's variable, and not computed again for each element
    each = F.transform(F.array(names), runs)
    each = F.transform(each, lambda r: F.sort_array(F.filter(r, lambda x: x.isNotNull())))
    least = F.slice(F.flatten(F.transform(each, first_of_each)), 1, sketch)
    return F.array_join(F.transform(least, lambda x: F.concat(F.lpad(F.lower(F.hex(x["h"])), 8, "0"), F.lpad(F.lower(F.hex(x["i"])), 8, "0"))), "")


def likeness(a: Column, b: Column, sketch: int = SKETCH) -> Column:
    """Estimated share (Jaccard) of anchors in common and displaced alike, 0 to 1; 1 for equal fingerprints, also empty ones.

    Of both texts' anchors the ``sketch`` least names are a sample of their union;
    those of them that both hold and that match by position are counted.
    """

    def marks(f: Column) -> Column:
        return F.regexp_extract_all(f, F.lit(f"[0-9a-f]{{{_MARK}}}"), F.lit(0))

    def name(mark: Column) -> Column:
        return F.left(mark, F.lit(8))

    def place(mark: Column) -> Column:
        return F.conv(F.substring(mark, 9, 8), 16, 10).cast("int")

    def matched(common: Column) -> Column:
        """Of (place, shift) sorted by place: those with a neighbour that is displaced alike; a single one counts."""
        def alike(x: Column, k: Column) -> Column:
            near = F.lit(False)
            for step in (-1, 1):
                there = F.get(common, k + step)
                near = near | F.coalesce((k + step >= 0) & (F.abs(there["d"] - x["d"]) <= SLACK), F.lit(False))
            return near | (F.size(common) == 1)

        return F.size(F.filter(common, alike))

    def share(pair: Column) -> Column:
        x, y = F.get(pair, 0), F.get(pair, 1)
        return F.get(F.transform(F.array(F.struct(x.alias("x"), y.alias("y"), F.transform(y, name).alias("n"), F.slice(F.sort_array(F.array_union(F.transform(x, name), F.transform(y, name))), 1, sketch).alias("u"))), counted), 0)

    def counted(s: Column) -> Column:
        at = F.transform(F.filter(s["x"], lambda m: F.array_contains(s["n"], name(m)) & F.array_contains(s["u"], name(m))), lambda m: F.struct(place(m).alias("p"), (place(F.get(s["y"], F.array_position(s["n"], name(m)).cast("int") - 1)) - place(m)).alias("d")))
        both = F.get(F.transform(F.array(F.sort_array(at)), matched), 0)
        return both.cast("double") / F.greatest(F.size(s["u"]), F.lit(1))

    return F.when(a == b, F.lit(1.0)).otherwise(F.get(F.transform(F.array(F.array(marks(a), marks(b))), share), 0))


def syncmer_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike neighbours are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first
    as many (or all) of the next document's, in ascending id order and after the
    last the first.  Returns (id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next).  A null text counts as empty.  Rows
    that share an id are each fingerprinted, and their next document is the next
    larger id's (of its rows, the least text).  A row without an id has no next
    document: its text is edited with nothing, and near_next is null.  Of a single
    id the next document is itself.  An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # both joins read `own` by a key that is never null itself, and use the
    # same columns, so that they share one exchange of the texts
    own = docs.select(F.struct(F.col(id_col).alias("id")).alias("key"), F.col(id_col).alias("id"), text.alias("text")).withColumn("n", F.char_length("text")).withColumn("fp", fingerprint(F.col("text"), sketch))
    ids = docs.select(F.col(id_col).alias("id"), F.char_length(text).alias("n"))
    after = successors(ids.select("id"), ["id"], wrap=True)
    wants = ids.dropna().groupBy("id").agg(F.max("n").alias("n")).join(after, "id").select(F.col("id").alias("of"), F.struct(F.col("next_id").alias("id")).alias("key"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    heads = own.join(wants, "key").select("of", F.struct(F.col("text").substr(F.lit(1), F.greatest("take", F.lit(1))).alias("head"), "fp", "n", "id").alias("next"))
    heads = heads.groupBy(F.struct(F.col("of").alias("id")).alias("key")).agg(F.min("next").alias("next"))
    both = own.join(heads, "key", "left")
    cut = F.floor(F.col("n") / 4).cast("int")
    tail = F.when(cut > 0, F.coalesce(F.col("next.head").substr(F.lit(1), cut), F.lit(""))).otherwise("")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n") - cut), tail)
    out = both.select("id", "n", "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited")).withColumn("efp", fingerprint(F.col("edited"), sketch))
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp"), sketch).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), sketch).alias("near_next"))
