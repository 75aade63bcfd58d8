"""Secret scans with multipart credential linking, by built-in functions only.

Strong finds (kinds assign, access, hex) are reported wherever they stand.
Weak parts -- short assigned values, account names and service endpoints --
are common in clean text, so they are reported only where a complementary
part stands in the same scope.  Every part has a role: identifier (access,
account), secret (assign, hex, weak_secret) or endpoint.  An interval join
over bins of a text's code points finds for each weak part the parts of
another role that start or end within ``scope`` code points of it.

Spans are in code points, end exclusive.  Null and empty texts have no spans
and get a row.  A text is known by its id and a hash of its characters: rows
that repeat both get the same spans, rows that share only the id (or have
none) are texts of their own.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerlens.session import materialize

#: Code points around a weak part in which a complementary part makes it a find.
SCOPE = 200

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ACCOUNT = r"""((?i:user(?:_?name)?|login|client_?id|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
ENDPOINT = r"""((?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://)([^\x00-\x20"'<>|]{4,})"""

#: (pattern, group whose length is measured) by source kind.
PATTERNS = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "account": (ACCOUNT, 2), "endpoint": (ENDPOINT, 2)}
#: Lengths of an assigned value that make it a strong find, and a weak part.
STRONG_VALUE, WEAK_VALUE = 12, 6
#: Kinds in the order that breaks ties of equal starts; the first three are strong.
KINDS = ("assign", "access", "hex", "weak_secret", "account", "endpoint")
ROLES = {"access": "id", "account": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret", "endpoint": "endpoint"}
TEXT_KEY = ["__id", "__hash"]


def pieces(text: Column, pattern: str, group: int) -> Column:
    """(g, m, n) of every leftmost match: code points between it and the match before, its own, and those of the group.

    The text between matches (``split``) and the matches alternate, so running
    sums of g and m are the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    zipped = F.transform(F.arrays_zip(gaps.alias("g"), found.alias("m"), inner.alias("n")),
                         lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["n"]).alias("n")))
    return F.when(text.rlike(pattern), F.filter(zipped, lambda x: x["m"].isNotNull()))


def _keyed(docs: DataFrame, id_col: str, text: str) -> list[Column]:
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    return [F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("__id"), F.xxhash64(docs[id_col], t).alias("__hash"), t.alias("__text")]


def parts(read: DataFrame) -> DataFrame:
    """One row a part: __id, __hash, kind, s, e.  read: the text key and one array of pieces for each pattern."""
    one = None
    for kind in PATTERNS:
        rows = read.filter(F.col(kind).isNotNull()).select(*TEXT_KEY, F.lit(kind).alias("source"), F.posexplode(kind).alias("i", "x"))
        one = rows if one is None else one.unionByName(rows)
    # rows that repeat a text bring its pieces again; one of each counts
    one = one.repartition(*TEXT_KEY).groupBy(*TEXT_KEY, "source", "i").agg(F.first("x").alias("x"))
    upto = Window.partitionBy(*TEXT_KEY, "source").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.select(*TEXT_KEY, "source", (F.sum(F.col("x.g") + F.col("x.m")).over(upto)).cast("int").alias("e"),
                        F.col("x.m").alias("m"), F.col("x.n").alias("n"))
    kind = F.when(F.col("source") != "assign", F.col("source")).when(F.col("n") >= STRONG_VALUE, "assign") \
        .when(F.col("n") >= WEAK_VALUE, "weak_secret")
    return placed.select(*TEXT_KEY, kind.alias("kind"), (F.col("e") - F.col("m")).alias("s"), "e").filter("kind is not null")


def linked(found: DataFrame, scope: int) -> DataFrame:
    """The weak parts that have a part of another role within ``scope`` code points.

    Both sides are laid out over bins of ``scope`` code points and joined on
    text and bin; a bin holds few parts, however long the text.
    """
    role = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])[F.col("kind")]
    bins = lambda lo, hi: F.explode(F.sequence((lo / scope).cast("int"), (hi / scope).cast("int")))
    one = found.withColumn("role", role)
    weak = one.filter(F.col("kind").isin(*KINDS[3:])).select(
        *TEXT_KEY, "kind", "s", "e", "role", bins(F.greatest(F.col("s") - scope, F.lit(0)), F.col("e") + scope).alias("bin"))
    other = one.select(F.col("__id").alias("oid"), F.col("__hash").alias("ohash"), F.col("role").alias("orole"),
                       F.col("s").alias("os"), F.col("e").alias("oe"), bins(F.col("s"), F.col("e")).alias("obin"))
    near = (F.col("__id") == F.col("oid")) & (F.col("__hash") == F.col("ohash")) & (F.col("bin") == F.col("obin")) \
        & (F.col("role") != F.col("orole")) & (F.col("os") <= F.col("e") + scope) & (F.col("oe") >= F.col("s") - scope)
    return weak.join(other, near, "left_semi").select(*TEXT_KEY, "kind", "s", "e").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """The id column and ``spans``, array<struct<s,k,e>> by start, then kind (k: place in ``KINDS``), a row for each row."""
    read = docs.select(docs[id_col], *_keyed(docs, id_col, text))
    read = materialize(read.select(id_col, *TEXT_KEY, *[pieces(F.col("__text"), *p).alias(k) for k, p in PATTERNS.items()]), "pieces")
    return read.select(id_col, *TEXT_KEY).join(_reported(read, scope), TEXT_KEY, "left").select(
        id_col, F.coalesce("spans", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("spans"))


def _reported(read: DataFrame, scope: int) -> DataFrame:
    found = materialize(parts(read), "parts")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    told = found.filter(F.col("kind").isin(*KINDS[:3])).unionByName(linked(found, scope))
    return told.groupBy(*TEXT_KEY).agg(F.sort_array(F.collect_list(
        F.struct(F.col("s"), order.alias("k"), F.col("e")))).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", mark: str = "[SECRET]", scope: int = SCOPE,
           only: tuple[str, ...] = KINDS) -> DataFrame:
    """All columns of ``docs``; each run of overlapping spans of the kinds ``only`` in its text becomes ``mark``."""
    keys = _keyed(docs, id_col, text)
    read = docs.select(*keys).select(*TEXT_KEY, *[pieces(F.col("__text"), *p).alias(k) for k, p in PATTERNS.items()])
    read = materialize(read.filter(" or ".join(f"{k} is not null" for k in PATTERNS)), "pieces")
    wanted = [i for i, k in enumerate(KINDS) if k in only]
    spans = _reported(read, scope).withColumn("spans", F.filter("spans", lambda x: x["k"].isin(*wanted)))
    # the spans come by start: a gap runs from the largest end so far to a later start
    span = Window.partitionBy(*TEXT_KEY).orderBy("x.s", "x.k").rowsBetween(Window.unboundedPreceding, -1)
    gap = spans.select(*TEXT_KEY, F.explode("spans").alias("x")).select(
        *TEXT_KEY, F.coalesce(F.max("x.e").over(span), F.lit(0)).alias("a"), F.col("x.s").alias("b"), F.col("x.e").alias("e"))
    gaps = gap.groupBy(*TEXT_KEY).agg(F.max("e").alias("end"), F.sort_array(F.collect_list(
        F.when((F.col("b") > F.col("a")) | (F.col("b") == 0), F.struct("a", "b")))).alias("gaps"))
    full = docs.select(F.struct(*docs.columns).alias("__row"), *keys[:2]).join(gaps, TEXT_KEY, "left")
    old = F.col("__row").getField(text)
    new = F.concat(F.array_join(F.concat(F.transform("gaps", lambda x: old.substr(x["a"] + 1, x["b"] - x["a"])), F.array(F.lit(""))), mark),
                   old.substr(F.col("end") + 1, F.length(old)))
    return full.select(*[F.when(F.col("gaps").isNotNull(), new).otherwise(old).alias(c) if c == text else F.col("__row").getField(c).alias(c)
                         for c in docs.columns])
