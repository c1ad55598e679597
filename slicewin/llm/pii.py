r"""Operator 1: information-theoretic sanitisation, in DataFrame operations only.

Base spans are found by patterns: email, ip, card, phone. Protected entities are each distinct value of a
base span and the classes it belongs to: its kind, the domain of an email, the first two and three numbers
of an ip, the leading digits of a card or phone. The terms of a document are its words outside base spans (which
are blanked kind by kind), wherever they stand. Corpus counts tell how strongly a term reveals an entity: with p the share of documents,
the term discloses PMI = log(p(term, entity) / (p(term) p(entity))) of the entity's information
IC = -log p(entity). A term that discloses at least THRESHOLD of it, in at least SUPPORT documents, is removed
wherever it stands, also from documents without the entity; it becomes a span of kind ``term``. All documents count.

Secrets (keys, tokens of access) reveal themselves by their own information: a run of at least SECRET letters and
digits, of both, whose length times the binary logarithm of its number of different characters is BITS or more, and that
is no part of a base span, becomes a span of kind ``secret``. The shortest such runs are beyond chance for words and numbers.

Texts are cut at the matches, so positions are sums of lengths in code points. The patterns begin
where no longer match could have begun, which keeps long runs linear and changes no match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slicewin.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Runs that can be secrets, by length.
SECRET, BITS = 20, 64
RUN_OF = rf"(?<![A-Za-z0-9])[A-Za-z0-9]{{{SECRET},}}+"
#: What each run of letters and digits holds somewhere.
MEETING = "[0-9][A-Za-z]|[A-Za-z][0-9]"
WORD = r"[\p{L}\p{M}\p{Nd}]+"
SUPPORT, THRESHOLD = 3, 0.9
SPAN = "struct<start:int,end:int,value:string>"
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def located(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<start, end, value>>: leftmost matches that do not overlap, in code points, end exclusive; only ``wanted`` values.

    Places are sums over runs of RUN matches and sums within a run, as an accumulator that grows with the matches
    would be copied for each of them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    none = F.array().cast(f"array<{SPAN}>")
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    long_ = lambda matches: F.aggregate(matches, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["value"]))

    def run_of(run: Column, before: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            start = before + long_(F.slice(run, F.lit(1), i)) + x["gap"]
            return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"].alias("value"))

        return F.transform(run, span)

    def all_of(runs: Column) -> Column:
        placed = lambda sizes: F.transform(runs, lambda run, j: run_of(run, F.aggregate(F.slice(sizes, F.lit(1), j), F.lit(0), lambda n, x: n + x)))
        return F.flatten(let(F.transform(runs, long_), placed))

    runs = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / RUN).cast("int")), lambda j: F.slice(m, j * RUN + 1, F.lit(RUN)))
    spans = let(both, lambda m: let(runs(m), all_of))
    spans = spans if wanted is None else F.filter(spans, lambda s: wanted(s["value"]))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    each = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.try_cast("int")).otherwise(F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(d.try_cast("int"), F.lit(0)) + 1))),
        F.lit(0),
        lambda a, b: a + F.coalesce(b, F.lit(0)),
    )
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def entities(kind: str):
    """The protected entities of a span: its value, the classes of its value, its kind; as hashes."""

    def of(s: Column) -> Column:
        value = F.lower(s["value"]) if kind in ("email", "ip") else digits(s["value"])
        if kind == "email":
            domain = F.substring_index(value, "@", -1)
            classes = [domain, F.substring_index(domain, ".", -2)]
        elif kind == "ip":
            classes = [F.substring_index(value, ".", n) for n in (2, 3)]
        else:
            classes = [F.substring(value, 1, n) for n in ((6,) if kind == "card" else (3, 6))]
        return F.array(F.xxhash64(F.lit(kind)), F.xxhash64(F.lit(kind), F.lit("value"), value), *[F.xxhash64(F.lit(kind), F.lit(str(i)), c) for i, c in enumerate(classes)])

    return of


def secret(value: Column) -> Column:
    bits = F.length(value) * F.log2(F.size(F.array_distinct(F.split(value, ""))))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (bits >= BITS)


def labelled(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"])


def joined(spans: Column, kind: Column | None = None) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"].cast("string"), s["end"].cast("string"))))


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, doc (hash of id and text), text, and for each kind its spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("doc"))
    hints = {"email": F.col("text").contains("@"), "ip": F.col("text").contains("."), "card": F.lit(True), "phone": F.col("text").contains("+")}
    none = F.array().cast(f"array<{SPAN}>")
    for k in KINDS:
        rows = rows.withColumn(k, F.when(hints[k], located(F.col("text"), PATTERNS[k], lambda value, k=k: valid(k, value))).otherwise(none))
    return rows


def words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def blanked(text: Column, kind: str) -> Column:
    """``text`` with spaces for the valid matches of a kind, in one pass over its pieces."""
    pattern = PATTERNS[kind]
    spaces = lambda v: F.when(valid(kind, v), F.repeat(F.lit(" "), F.length(v))).otherwise(v)
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, v: F.concat(p, F.coalesce(spaces(v), F.lit(""))))
    return F.array_join(parts, "")


def disclosing(spans: DataFrame) -> DataFrame:
    """The terms that disclose enough of an entity; document frequencies over all documents.

    With p the share of documents, PMI / IC is at least THRESHOLD if both / df is at least p(entity) ** (1 -
    THRESHOLD). So terms that are not in that share of the documents with base spans, for the rarest entity
    of SUPPORT documents, are left out before pairs are made, which loses none.
    """
    found = F.flatten(F.array(*[F.flatten(F.transform(k, entities(k))) for k in KINDS]))
    held = materialize(spans.where(F.col("bare").isNotNull()).select("doc", "bare", F.array_distinct(found).alias("entities")).dropDuplicates(["doc"]), "pii-held")
    rest = spans.where(F.col("bare").isNull())
    n = float(held.count() + rest.count())
    of = held.select("doc", F.explode("entities").alias("entity"))
    recurring = of.groupBy("entity").agg(F.count(F.lit(1)).alias("of")).where((F.col("of") >= SUPPORT) & (F.col("of") < n))
    inside = held.select("doc", F.explode(words(F.col("bare"))).alias("term"))
    terms = materialize(inside.groupBy("term").agg(F.count(F.lit(1)).alias("inside")).where(F.col("inside") >= SUPPORT), "pii-inside")
    outside = rest.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("outside"))
    terms = terms.join(outside, "term", "left").select("term", "inside", (F.col("inside") + F.coalesce("outside", F.lit(0))).alias("df"))
    terms = materialize(terms.where(F.col("inside") >= 0.999 * F.col("df") * (SUPPORT / max(n, SUPPORT)) ** (1 - THRESHOLD)), "pii-terms")
    pairs = inside.join(terms.select("term", "df"), "term").join(of.join(recurring, "entity"), "doc")
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"), F.first("of").alias("of"), F.first("df").alias("df")).where(F.col("both") >= SUPPORT)
    ratio = F.log(F.lit(n) * F.col("both") / (F.col("df") * F.col("of"))) / -F.log(F.col("of") / F.lit(n))
    return materialize(pairs.where(ratio >= THRESHOLD).select("term").distinct(), "pii-disclosing")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_email, n_ip, n_card, n_phone, base (array of kind, start, end), terms and secrets (alike).

    A null text is empty and has no spans. Repeated rows get equal spans; those with base spans count as one
    document, those without as documents each. Copies under other ids are documents of their own. A very long text
    is searched whole, in time that grows with its length. Other
    columns are not read; an empty table gives no rows.
    """
    spans = base_spans(docs, id_col, text_col)
    base = F.concat(*[F.transform(k, labelled(k)) for k in KINDS])
    spans = spans.withColumn("bare", F.when(F.size(base) > 0, F.col("text")))
    for k in KINDS:
        spans = spans.withColumn("bare", F.when(F.size(k) > 0, blanked(F.col("bare"), k)).otherwise(F.col("bare")))
    spans = materialize(spans, "pii")
    bare = F.coalesce("bare", "text")
    hits = spans.select("doc", F.explode(words(bare)).alias("term")).join(disclosing(spans), "term", "left_semi")
    hits = materialize(hits.groupBy("doc").agg(F.collect_set("term").alias("found")), "pii-hits")
    rows = spans.join(hits, "doc", "left").withColumn("base", base)
    own = located(bare, WORD, lambda value: F.array_contains("found", F.lower(value)))
    # Spans of different kinds may overlap; what one of them leaves of another is no term.
    apart = lambda t: ~F.exists("base", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    terms = F.when(F.col("found").isNotNull(), F.transform(F.filter(own, apart), labelled("term"))).otherwise(none)
    runs = located(F.col("text"), RUN_OF, secret)
    secrets = F.when(F.col("text").rlike(MEETING) & F.col("text").rlike(RUN_OF), F.transform(F.filter(runs, apart), labelled("secret"))).otherwise(none)
    return rows.select("doc_id", "text", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], "base", terms.alias("terms"), secrets.alias("secrets"))


def sanitize(found: DataFrame) -> DataFrame:
    """``found`` with column sanitized: base spans and secrets generalised to their kind, disclosing terms removed.

    The time for a text grows with its length times the number of its spans.
    """
    cuts = F.array_sort(F.transform(F.concat("base", "terms", "secrets"), lambda s: F.struct(s["start"], s["end"], s["kind"])))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        keep = F.substring(F.col("text"), s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0)))
        put = F.when(c["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), c["kind"], F.lit("]")))
        return F.struct(F.greatest(s["at"], c["end"]).alias("at"), F.concat(s["out"], keep, put).alias("out"))

    return found.withColumn("sanitized", F.aggregate(cuts, zero, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text")))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    spans = F.concat("base", "terms", "secrets")
    more = [F.size("secrets").cast("long").alias("n_secret"), F.size("terms").cast("long").alias("n_term"), F.size(spans).cast("long").alias("n_spans")]
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"), *more)
