"""Secrets in whole texts, told apart by who owns them. DataFrame functions only.

Every match of the base patterns is a span. Longer mixed-case tokens are
candidates besides. All values are hashed, and the hashes counted over the
corpus by distinct repositories and owners: a value that many owners hold is
a copied example, one that a single owner holds looks live. Candidates that
overlap no base span and have one owner in few repositories become spans too.

A null text is an empty one. A null owner or repository counts as one of its
own. Rows are kept as they come, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.llm.common import free_name
from gazetta.session import stash

#: Fixed by the contract: (kind, prefix group, value group, least code points of the value).
PATTERNS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 12),
    ("access", r"()(AKIA[A-Z0-9]+)", 18),
    ("hex", r"()([0-9a-f]+)", 16),
)
BASE = [p[0] for p in PATTERNS]
CANDIDATE = "token"
TOKEN = r"()([A-Za-z0-9_-]{24,})"
#: Marks of a match, of its value and of its end; in texts they are blanked first.
START, VALUE, END = "\u0001", "\u0002", "\u0003"


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(f"{START}$1{VALUE}$2{END}"))


def secret_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = None, row_col: str | None = None) -> DataFrame:
    """(row, doc_id, repo, owner, kind, start, end, value_hash), and one row without a kind for a document that has none.

    ``row_col`` numbers the rows; without one they are numbered here.
    start and end are code points. A match is marked in the text, which is
    then split at the marks; running sums of the parts' lengths give places.
    """
    clean = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), START + VALUE + END, "\u0004\u0004\u0004")
    base = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(repo_col or id_col).cast("string").alias("repo"),
        (F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")).alias("owner"),
        clean.alias("text"),
    )
    # Runs shorter than the least are left unmarked where that can't change a later match.
    rules = [("assign", PATTERNS[0][1]), ("access", PATTERNS[1][1]), ("hex", "()([0-9a-f]{16,})"), (CANDIDATE, TOKEN)]
    worth = {"access": F.contains("text", F.lit("AKIA"))}
    made = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(worth.get(k, F.lit(True)), _marked(F.col("text"), p)).alias("marked")) for k, p in rules])
    found = base.select("row", "doc_id", "repo", "owner", F.explode_outer(F.filter(made, lambda x: F.contains(x["marked"], F.lit(START)))).alias("x"))
    parts = found.select("row", "doc_id", "repo", "owner", F.col("x.kind").alias("kind"), F.posexplode_outer(F.split("x.marked", START)).alias("at", "part"))
    head = F.substring_index("part", VALUE, 1)
    value = F.substring_index(F.substring_index("part", VALUE, -1), END, 1)
    sized = parts.select(
        "row", "doc_id", "repo", "owner", "kind", "at",
        F.when(F.col("at") > 0, value).alias("value"),
        F.when(F.col("at") > 0, F.length(head)).otherwise(0).alias("head"),
        (F.length("part") - F.when(F.col("at") > 0, 2).otherwise(0)).alias("advance"),
    )
    before = F.coalesce(F.sum("advance").over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sized.select("row", "doc_id", "repo", "owner", "kind", "at", "value", "head", before.cast("long").alias("start"))
    least = F.create_map(*[x for k, _, n in PATTERNS for x in (F.lit(k), F.lit(n))], F.lit(CANDIDATE), F.lit(24))
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    good = (F.col("at") > 0) & (F.length("value") >= least[F.col("kind")]) & ((F.col("kind") != CANDIDATE) | mixed)
    # For each document and kind the row at 0 stays as its anchor, so that documents without a match are not lost.
    kept = placed.where(good | F.col("at").isNull() | (F.col("at") == 0))
    hit = F.coalesce(F.col("at") > 0, F.lit(False))
    return kept.select(
        "row", "doc_id", "repo", "owner",
        F.when(hit, F.col("kind")).alias("kind"),
        F.when(hit, F.col("start")).alias("start"),
        F.when(hit, F.col("start") + F.col("head") + F.length("value")).alias("end"),
        F.when(hit, F.xxhash64("value")).alias("value_hash"),
    )


def ownership(matches: DataFrame) -> DataFrame:
    """(value_hash, owners, repos): distinct holders of each value, pre-aggregated pair by pair."""
    pairs = matches.where("value_hash is not null").groupBy("value_hash", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = pairs.groupBy("value_hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str | None = None, example_owners: int = 3, live_repos: int = 3, row_col: str | None = None, over_copied: bool = False) -> DataFrame:
    """One row per row of ``docs``: row, doc_id, base and added (arrays of start, order, kind, end, live, copied), n_live, n_copied.

    With ``over_copied`` a live candidate is added also where it overlaps copied base spans only.
    """
    matches = stash(secret_matches(docs, id_col, text_col, repo_col, owner_col, row_col))
    known = ownership(matches)
    hits = matches.where("kind is not null").join(known, "value_hash", "left")
    order = F.array_position(F.array(*[F.lit(k) for k in (*BASE, CANDIDATE)]), F.col("kind")).cast("int")
    live = (F.col("owners") == 1) & (F.col("repos") <= live_repos)
    span = F.struct("start", order.alias("order"), "kind", "end", live.alias("live"), (F.col("owners") >= example_owners).alias("copied"))
    per_row = hits.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    rows = matches.groupBy("row").agg(F.first("doc_id").alias("doc_id"))
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint,live:boolean,copied:boolean>>")
    out = rows.join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", empty))
    out = out.withColumn("base", F.filter("spans", lambda x: x["kind"] != CANDIDATE))
    bars = F.filter("base", lambda b: ~b["copied"]) if over_copied else F.col("base")
    extra = F.filter("spans", lambda x: (x["kind"] == CANDIDATE) & x["live"] & ~F.exists(bars, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.withColumn("added", extra)
    both = F.concat("base", "added")
    return out.select("row", "doc_id", "base", "added", F.size(F.filter(both, lambda x: x["live"])).cast("long").alias("n_live"), F.size(F.filter(both, lambda x: x["copied"])).cast("long").alias("n_copied"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", id_col: str = "doc_id", repo_col: str | None = None, owner_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """``docs`` with the values of its secrets replaced by ``mark``: base and added spans, but for copied examples.

    Other texts are unchanged, null ones too. ``length_col`` gets the new
    length where a text has changed. Overlapping values have one mark.
    """
    row, found_spans = free_name(docs, "_row"), free_name(docs, "_spans")
    # Rows are numbered once and written, so that spans come back to the rows in which they were found.
    rows = stash(docs.withColumn(row, F.monotonically_increasing_id()))
    found = scan_secrets(rows, id_col, text_col, repo_col, owner_col, row_col=row, over_copied=True)
    spans = F.array_sort(F.filter(F.concat("base", "added"), lambda x: ~x["copied"]))
    hidden = found.select(F.col("row").alias(row), F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["kind"].alias("kind"))).alias(found_spans)).where(F.size(found_spans) > 0)
    text = F.col(text_col).cast("string")
    clean = F.translate(text, START + VALUE + END, "\u0004\u0004\u0004")

    def value(x: Column) -> Column:
        """Of an assignment, the part after its prefix."""
        prefix = F.regexp_extract(F.substring(clean, x["start"] + 1, x["end"] - x["start"]), PATTERNS[0][1], 1)
        return F.struct((x["start"] + F.when(x["kind"] == "assign", F.length(prefix)).otherwise(0)).alias("start"), x["end"].alias("end"))

    def step(done: Column, x: Column) -> Column:
        new = x["start"] >= done["at"]
        parts = F.when(new, F.concat(done["parts"], F.array(F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit(mark)))).otherwise(done["parts"])
        return F.struct(parts.alias("parts"), F.greatest(done["at"], x["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))
    values = F.array_sort(F.transform(found_spans, value))
    shown = F.aggregate(values, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))
    changed = F.col(found_spans).isNotNull()
    out = rows.join(hidden, row, "left").withColumn(text_col, F.when(changed, shown).otherwise(F.col(text_col)))
    if length_col:
        out = out.withColumn(length_col, F.when(changed, F.length(text_col).cast("long")).otherwise(F.col(length_col)))
    return out.select(*docs.columns)
