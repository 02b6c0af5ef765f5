"""Order MinHash fingerprints and a distributed look at each row's neighbour, in SQL expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import let

#: A token is one ideograph or kana, or up to 16 other characters that are not white space.
TOKEN = r"[\u3040-\u30FF\u3400-\u9FFF]|[^\s\u3040-\u30FF\u3400-\u9FFF]{1,16}"
GROUPS, PICKS, K = 32, 2, 2
_POS, _HASH = 30, 28  # bits of a position (a text has less than 2^30 tokens) and of a hash in one sortable long


def fingerprint(text: Column, groups: int = GROUPS, picks: int = PICKS, k: int = K) -> Column:
    """Order MinHash of a text: comma-joined entries of two hex digits (the group) and eight (the tuple's hash).

    Tokens are cut by one rule, whatever the text's length and script. Its k-token shingles are numbered by occurrence, hashed, and dealt to `groups` by hash; of each group the `picks`
    least hashes are kept, put back in text order, and their shingles hashed as a tuple. Equal texts get equal
    fingerprints; null and tokenless texts get the empty string. A group without shingles has no entry.
    """
    bits = (groups - 1).bit_length()
    low = F.lit((1 << _POS) - 1)
    span = F.lit((1 << (_HASH + bits)) - 1)
    none = F.expr("cast(array() as array<int>)")
    kind = lambda x: F.shiftright(x, _POS)
    group = lambda x: F.shiftright(x, _POS + _HASH)
    hashes = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))

    place = lambda e, x: F.shiftleft(e.bitwiseAND(span), _POS).bitwiseOR(x)

    def shingled(h: Column) -> Column:
        """(group, hash, position) of every shingle in one long each, in order; a text of fewer tokens than k is one."""
        at = F.when(F.size(h) == 0, none).otherwise(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))))
        return F.sort_array(F.transform(at, lambda i: place(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), i.cast("long").bitwiseAND(low))))

    def numbered(s: Column) -> Column:
        """Equal shingles stand together, in text order: all but the first get a hash of shingle and number instead."""

        def later(again: Column) -> Column:
            runs = let(
                F.filter(F.sequence(F.lit(0), F.size(again) - 1), lambda i: (i == 0) | (kind(F.get(again, i)) != kind(F.get(again, i - 1)))),
                lambda b: F.flatten(
                    F.transform(
                        b,
                        lambda i, j: F.transform(
                            F.sequence(i, F.coalesce(F.get(b, j + 1), F.size(again)) - 1),
                            lambda p: let(F.get(again, p), lambda x: place(F.xxhash64(kind(x), p - i + 1), x.bitwiseAND(low))),
                        ),
                    )
                ),
            )
            once = F.filter(s, lambda x, i: F.coalesce(kind(x) != kind(F.get(s, i - 1)), F.lit(True)))
            return F.when(F.size(again) == 0, s).otherwise(F.sort_array(F.concat(once, runs)))

        return let(F.filter(s, lambda x, i: kind(x) == kind(F.get(s, i - 1))), later)

    def entries(c: Column) -> Column:
        def entry(i: Column) -> Column:
            own = F.filter(F.slice(c, i + 1, picks), lambda x: group(x) == group(F.get(c, i)))
            ordered = F.sort_array(F.transform(own, lambda x: F.struct(x.bitwiseAND(low), kind(x))))
            tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x["col2"]))
            return F.concat(F.lpad(F.hex(group(F.get(c, i))), 2, "0"), F.lpad(F.hex(tuple_hash.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))

        firsts = F.filter(F.transform(c, lambda x, i: F.when(group(x) == group(F.get(c, i - 1)), F.lit(None)).otherwise(i)), lambda i: i.isNotNull())
        return F.array_join(F.transform(firsts, entry), ",")

    return let(let(let(hashes, shingled), numbered), entries)


def likeness(a: Column, b: Column) -> Column:
    """Share of the groups that either fingerprint has in which both hold the same tuple; 1 for two empty ones."""
    parts = lambda x: F.filter(F.split(x, ","), lambda e: e != "")
    names = lambda x: F.transform(x, lambda e: F.substring(e, 1, 2))
    return let(
        F.struct(parts(a).alias("a"), parts(b).alias("b")),
        lambda s: let(
            F.size(F.array_union(names(s["a"]), names(s["b"]))),
            lambda n: F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / n),
        ),
    ).cast("double")


def with_next(rows: DataFrame, key: str, value: Column, tie: str, name: str = "next", per_bucket: int = 2000, most_buckets: int = 4096) -> DataFrame:
    """Add `name`: the value of the next row by descending key (nulls last, ties by `tie`); after the last comes the first.

    No task sees all rows: quantiles of the key cut the order into buckets, a window works within each, and a copy of
    a bucket's first row is put behind the bucket before it. At most `most_buckets` keys reach the driver.
    """
    n = rows.count()
    if not n:
        return rows.withColumn(name, value)
    wanted = max(1, min(most_buckets, -(-n // per_bucket)))
    bounds = []
    if wanted > 1:
        cut = rows.select(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 20 * wanted)).head()[0]
        bounds = sorted({int(b) for b in cut or []})
    held = F.lit(bounds) if bounds else F.expr("cast(array() as array<bigint>)")
    bucket = F.lit(0)
    if bounds:
        steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
        bucket = F.aggregate(
            F.lit(steps),
            F.lit(0),
            lambda lo, step: F.when((lo + step <= len(bounds)) & (F.get(held, lo + step - 1) <= F.coalesce(F.col(key), F.lit(-(1 << 63)))), lo + step).otherwise(lo),
        )
    placed = rows.select(F.struct("*").alias("row"), value.alias("value"), F.col(key).alias("key"), F.col(tie).alias("tie"), bucket.alias("bucket"))
    firsts = sorted(rows.select(F.col(key).alias("key"), bucket.alias("bucket")).groupBy("bucket").agg(F.max("key").alias("key")).collect(), reverse=True)
    behind = [(b, k, firsts[i - 1]["bucket"]) for i, (b, k) in enumerate(firsts)]
    marks = rows.sparkSession.createDataFrame(behind, "b int, k long, target int")
    at = placed.join(F.broadcast(marks), (F.col("bucket") == F.col("b")) & F.col("key").eqNullSafe(F.col("k")), "left")
    copies = F.filter(
        F.array(
            F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("copy")),
            F.struct(F.col("target").alias("bucket"), F.lit(1).alias("copy")),
        ),
        lambda c: c["bucket"].isNotNull(),
    )
    dealt = at.select("row", "value", "key", "tie", F.explode(copies).alias("to")).select(
        F.when(F.col("to.copy") == 0, F.col("row")).alias("row"), "value", "key", "tie", "to.bucket", "to.copy"
    )
    from pyspark.sql import Window

    order = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("key"), "tie")
    seen = dealt.withColumn("following", F.lead("value").over(order)).where("copy = 0")
    return seen.select("row.*", F.col("following").alias(name))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced by the start of the next one's.

    Null text: empty. Next: by descending id, after the last the first (a lone row is its own next). Rows of equal id
    follow by text. Extra columns are ignored; no rows: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("fingerprint", fingerprint(F.col("text")))
    seen = with_next(own, "doc_id", F.struct("text", "fingerprint"), "text")
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next.text", cut))
    out = seen.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    out = out.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
