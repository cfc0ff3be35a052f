"""Secret scans by multipart credential linking, in DataFrame functions only.

Three base kinds are found by pattern alone: assignments to secret-like names, access identifiers and long
hexadecimal runs. Other parts (account names, short or unusual secrets, endpoints) are weak candidates: they
say little alone, and are reported only where a complementary part lies in the same scope, which is one
document and `scope` code points around the part. Parts and scopes are intervals; they meet in an interval
join on (document, block of code points), so that work follows the parts, not the pairs of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import saved

# The base kinds in their order, and their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a run is matched whole from its first AKIA, so a shorter one holds no longer match
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "login", "weak_secret", "endpoint"]
#: Weak parts by kind.
LOGIN = r"""(?i)(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
WEAK_SECRET = r"""(?i)(?:pwd|pass|auth|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}"""
ENDPOINT = r"""(?i)(?:https?|ftp|jdbc|postgres|mysql|redis|mongodb|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""
#: Roles by kind: identifiers 0, secrets 1, endpoints 2; and which roles support a weak part of each role.
ROLES = [1, 0, 1, 0, 1, 2]
SUPPORT = {0: [1], 1: [0, 2], 2: [1]}
SCOPE, BLOCK, RUN = 200, 256, 64
SPAN = "array<struct<start:int,kind:int,end:int>>"
MASK = "[SECRET]"


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (m, gap): the match and the code points since the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    zipped = F.zip_with(matches, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap")))
    return F.filter(zipped, lambda x: x["m"].isNotNull())


def _spans(found: Column, kind: int) -> Column:
    """(start, kind, end, m) of matches, in code points.

    Appending to an array copies it, so matches are placed in runs of RUN, each from its own offset: a text full of
    matches costs their number times RUN, not its square.
    """
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))), lambda k: F.slice(found, k * RUN + 1, RUN))
    lengths = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["gap"] + F.length(x["m"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    offsets = F.aggregate(lengths, begin, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))["out"]

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    empty = F.array().cast("array<struct<start:int,kind:int,end:int,m:string>>")
    return F.flatten(F.zip_with(runs, offsets, lambda r, at: F.aggregate(r, F.struct(at.alias("at"), empty.alias("out")), step)["out"]))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"]))


def with_parts(docs: DataFrame, text: str, base: str, weak: str) -> DataFrame:
    """docs with two more columns: the base spans and the weak spans, each sorted. Null text counts as empty."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    patterns = [ASSIGN, ACCESS, HEX, LOGIN, WEAK_SECRET, ENDPOINT]
    held = docs.withColumns({f"__found{k}": _matches(t, p) for k, p in enumerate(patterns)})
    spans = [_spans(F.col(f"__found{k}"), k) for k in range(len(patterns))]
    long = F.filter(spans[0], lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12)
    found, more = F.concat(_plain(long), *map(_plain, spans[1:3])), F.concat(*map(_plain, spans[3:]))
    return held.withColumns({base: F.array_sort(found), weak: F.array_sort(more)}).drop(*[f"__found{k}" for k in range(len(patterns))])


def link_weak(parts: DataFrame, row: str, base: str, weak: str, scope: int = SCOPE) -> DataFrame:
    """(row, linked): for each row with linked weak spans, those that a complementary part supports, sorted.

    A weak span that overlaps a base span adds nothing and is left out.
    """
    roles = F.array(*map(F.lit, ROLES))
    all_parts = parts.select(F.col(row).alias("r"), F.explode(F.concat(base, weak)).alias("p"))
    sides = all_parts.select("r", F.col("p.start").alias("s"), F.col("p.end").alias("e"), F.col("p.kind").alias("k"))
    sides = sides.withColumn("role", F.element_at(roles, F.col("k") + 1))
    held = sides.select("r", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("role").alias("role2"), F.col("k").alias("k2"), F.explode(F.sequence((F.col("s") / BLOCK).cast("int"), (F.col("e") / BLOCK).cast("int"))).alias("block"))
    reach = sides.where(F.col("k") > 2).withColumn("block", F.explode(F.sequence((F.greatest(F.col("s") - scope, F.lit(0)) / BLOCK).cast("int"), ((F.col("e") + scope) / BLOCK).cast("int"))))
    met = reach.join(held, ["r", "block"]).where((F.col("s2") <= F.col("e") + scope) & (F.col("e2") >= F.col("s") - scope))
    supports = F.lit(False)
    for role, by in SUPPORT.items():
        supports = supports | ((F.col("role") == role) & F.col("role2").isin(by))
    covered = (F.col("k2") <= 2) & (F.col("s2") < F.col("e")) & (F.col("e2") > F.col("s"))
    linked = met.groupBy("r", "s", "k", "e").agg(F.bool_or(supports & ~covered).alias("ok"), F.bool_or(covered).alias("covered")).where("ok and not covered")
    return linked.groupBy("r").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("k").alias("kind"), F.col("e").alias("end")))).cast(SPAN).alias("linked"))


def scan_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE, keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (all, if None) with secret_base and secret_linked: arrays of (start, kind, end), kinds by number in KINDS.

    Rows with null or empty text have empty arrays; repeated rows are scanned each for itself; a column
    that has one of the added names is replaced; an empty table gives no rows. Very long texts are scanned
    whole. Null in other columns is kept.
    """
    kept = [F.col(f"`{x}`") for x in (docs.columns if keep is None else keep) if x not in ("secret_base", "secret_linked")]
    rows = with_parts(docs, text, "secret_base", "__weak").select(*kept, "secret_base", "__weak", F.monotonically_increasing_id().alias("__row"))
    rows = saved(rows, "secret-parts")
    linked = link_weak(rows, "__row", "secret_base", "__weak", scope).select(F.col("r").alias("__row"), F.col("linked").alias("__linked"))
    out = rows.join(linked, "__row", "left")
    return out.select(*kept, "secret_base", F.coalesce("__linked", F.array().cast(SPAN)).alias("secret_linked"))


def named(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """text with each span, or run of overlapping spans, replaced by the mask. spans are sorted by start."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and all spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, keep=["doc_id"])

    def count(kind: int) -> Column:  # no second parameter in the lambda: Spark would pass the index for it
        return F.size(F.filter("secret_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(named(F.col("secret_base")), 256).alias("base_sha256"), named(F.array_sort(F.concat("secret_base", "secret_linked"))).alias("spans"))
