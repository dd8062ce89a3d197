"""Audits and rewrites of brief texts, one row per brief."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gazetta.functions.text import contains_any
from gazetta.session import sized

#: Phrases of a hedged source and of a done deal, as plain substrings of lower-case text.
HEDGED = [
    "could", "may ", "might", "plans to", "planning to", "plans a", "planned", "is seeking", "seeking to", "reportedly",
    "is expected", "expected to", "considering", "in talks", "weighing", "rumored", "said to be", "is exploring", "exploring a",
    "is set to", "aims to", "intends to", "proposed", "potential", "would ", "is reportedly", "sources say", "eyeing", "in the works",
]
DONE = [
    "completed", "has completed", "closed", "has closed", "finalized", "has finalized", "secured", "has secured", "confirmed",
    "has confirmed", "signed", "has signed", "has agreed", "announced the completion", "officially",
]
#: Severities, the worst first.
SEVERITIES = ["critical", "important", "minor"]


def sections(briefs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, heading, body, is_theme): each second-level heading with its body."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text_col)), r"\n(?=## )")
    rows = briefs.select(id_col, F.posexplode(parts).alias("position", "part")).where(F.startswith("part", F.lit("## ")))
    heading = F.trim(F.substring(F.split_part("part", F.lit("\n"), F.lit(1)), 4, 1_000_000))
    cut = F.instr("part", "\n")
    body = F.when(cut > 0, F.expr("substring(part, instr(part, '\n') + 1)")).otherwise("")
    rows = rows.select(id_col, "position", heading.alias("heading"), body.alias("body"))
    return rows.withColumn("is_theme", ~contains_any(F.col("heading"), ["highlights", "investigations"]))


def critic(briefs: DataFrame, id_col: str, text_col: str, cap: int, least_themes: int = 3, overrun: float = 1.0) -> DataFrame:
    """(id, rule, severity, subject): structural faults. An empty brief has that one alone.

    Beyond ``overrun`` times the cap a brief overruns; before, it is just over.
    """
    parts = sections(briefs, id_col, text_col)
    # As decimals: 3000 * 1.15 in doubles is a little under 3450.
    bar = F.lit(cap * Decimal(str(overrun)))
    empty = briefs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) == "").select(id_col, F.lit("empty_brief").alias("rule"), F.lit("critical").alias("severity"), F.lit(None).cast("string").alias("subject"))
    sound = briefs.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "")
    themes = parts.groupBy(id_col).agg(F.count_if("is_theme").alias("themes"))
    one = sound.join(themes, id_col, "left").withColumn("themes", F.coalesce("themes", F.lit(0)))

    def fault(rows: DataFrame, rule: str, severity: str, subject: Column | None = None) -> DataFrame:
        return rows.select(id_col, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(None) if subject is None else subject).cast("string").alias("subject"))

    cited = F.contains("body", F.lit("]("))
    out = [
        fault(one.where("themes = 0"), "no_themes", "critical"),
        fault(one.where((F.col("themes") > 0) & (F.col("themes") < least_themes)), "few_themes", "minor"),
        fault(sound.where(~F.contains(text_col, F.lit("]("))), "no_citations", "critical"),
        fault(sound.where(F.length(text_col) > bar), "char_overrun", "important"),
        fault(sound.where((F.length(text_col) > cap) & (F.length(text_col) <= bar)), "char_over_cap", "minor"),
        fault(parts.where(F.trim("body") == ""), "empty_section", "important", F.col("heading")),
        fault(parts.where(F.col("is_theme") & (F.trim("body") != "") & ~cited), "theme_no_citation", "important", F.col("heading")),
    ]
    for x in out:
        empty = empty.unionByName(x)
    return empty


def gate(briefs: DataFrame, faults: DataFrame, id_col: str, least: str = "important") -> DataFrame:
    """(id, faults, worst, alert): every brief with its worst severity, and whether a fault is at ``least`` or above.

    An unknown ``least`` counts as the middle one. A fault of an unknown severity never alerts.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.lower("severity"))
    floor = SEVERITIES.index(least) + 1 if least in SEVERITIES else 2
    worst = faults.groupBy(id_col).agg(F.count("*").alias("faults"), F.min(F.when(rank > 0, rank)).alias("r"))
    out = briefs.select(id_col).join(worst, id_col, "left")
    named = F.element_at(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("r").cast("int"))
    return out.select(id_col, F.coalesce("faults", F.lit(0)).alias("faults"), F.when(F.col("r").isNotNull(), named).alias("worst"), F.coalesce(F.col("r") <= floor, F.lit(False)).alias("alert"))


def _one_line(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def tense_mismatch(source: Column, bullet: Column, hedged: list[str] | None = None, done: list[str] | None = None) -> Column:
    """A hedged source whose bullet states a done deal."""
    return contains_any(_one_line(source), hedged or HEDGED) & contains_any(_one_line(bullet), done or DONE)


def bullets(briefs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, url, line): the first line of each brief that cites an address as ``](url)``."""
    lines = briefs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("position", "line"))
    cited = lines.select(id_col, "position", "line", F.explode(F.regexp_extract_all("line", F.lit(r"\]\(([^)\s]+)\)"), F.lit(1))).alias("url"))
    return cited.groupBy(id_col, "url").agg(F.min_by("line", "position").alias("line"))


def overstated(highlights: DataFrame, briefs: DataFrame, id_col: str, text_col: str, chars: int = 1000) -> DataFrame:
    """``highlights`` (id, url, title, differentiator, reasoning, body) whose own bullet in the brief, found by address, states as done what they hedge."""
    said = F.concat_ws(" ", "title", "differentiator", "reasoning", F.substring("body", 1, chars))
    found = highlights.join(bullets(briefs, id_col, text_col), [id_col, "url"])
    return found.where(tense_mismatch(said, F.col("line"))).drop("line")


def truncated_tail(text: Column, most: int = 5) -> Column:
    """The text without up to ``most`` closing lines that do not end a sentence; blank lines go with them.

    The last line that stays is found first, and the lines are cut there once.
    """
    ends = r"[.!?:;\"')\]*_]\s*$"
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    blank = lambda line: F.trim(line) == ""
    good = lambda line: ~blank(line) & (line.rlike(ends) | F.startswith(line, F.lit("#")) | (F.trim(line) == "---"))
    place = F.sequence(F.lit(1), F.size(lines))
    said = F.filter(place, lambda i: ~blank(F.element_at(lines, i)))
    sound = F.coalesce(F.array_max(F.filter(place, lambda i: good(F.element_at(lines, i)))), F.lit(0))
    # Where more than ``most`` lines are open, the one before those stays.
    kept = F.greatest(sound, F.coalesce(F.try_element_at(said, F.lit(-most - 1)), F.lit(0)))
    return F.array_join(F.slice(lines, F.lit(1), kept), "\n")


def over_cap(chars: Column, cap: Column | int, ratio: float = 1.0) -> Column:
    """Characters over the cap, null within its ratio."""
    return F.when(chars > cap * F.lit(Decimal(str(ratio))), chars - cap)


#: Characters that a theme's body should have by size, and the size of each length that a chat can ask for.
SIZES = {"S": 800, "M": 1600, "L": 3200}
LENGTHS = {"short": "S", "medium": "M", "long": "L"}


def _looked_up(x: Column, table: dict) -> Column:
    return F.create_map(*[y for k, v in table.items() for y in (F.lit(k), F.lit(v))])[x]


def size_level(length: Column, surface: Column, sizes: dict[str, int] | None = None, lengths: dict[str, str] | None = None) -> Column:
    """A chat's size: what its known length stands for, else its surface's; M where that is no size."""
    sizes = sizes or SIZES
    said = F.coalesce(_looked_up(length, lengths or LENGTHS), surface)
    return F.when(said.isin(list(sizes)), said).otherwise("M")


def theme_target(level: Column, sizes: dict[str, int] | None = None) -> Column:
    """Characters a theme's body should have; an unknown level counts as M."""
    sizes = sizes or SIZES
    return F.coalesce(_looked_up(level, sizes), F.lit(sizes["M"]))


def char_cap(target: Column, themes: Column, highlights: Column | int = 0, per_highlight: int = 250, per_source: int = 0) -> Column:
    """Characters that a brief may have: a body and a source list for each theme, and its highlights."""
    none = F.lit(0)
    return (target + max(0, per_source)) * F.greatest(none, themes) + F.greatest(none, F.lit(highlights) if isinstance(highlights, int) else highlights) * max(0, per_highlight)


def _by_line(text: Column, change) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), change), "\n")


#: A heading's marks and its text.
HEADING = r"^#{1,6}\s+(.*)$"
#: The link that a line ends with.
LAST_LINK = r"\[([^\[\]]+)\]\((https?://[^\s()]+)\)$"


def headings_to_bold(text: Column, marker: str = "**") -> Column:
    """Headings as bold lines, for surfaces without headings."""
    return _by_line(text, lambda x: F.when(x.rlike(HEADING), F.concat(F.lit(marker), F.trim(F.regexp_extract(x, HEADING, 1)), F.lit(marker))).otherwise(x))


def cited(text: Column, link: str = "hyperlink", source: bool = True, numbers: bool = True) -> Column:
    """Lines that cite, for a surface; other lines stay.

    An article's line ``[3] Title — [Source](address)`` becomes ``3. Title — `` and its source, without the number where
    ``numbers`` is false; a highlight's ``- **Title** — summary [Source](address)`` keeps its shape. ``link``: the source is a
    link (hyperlink), is followed by the address (plain), or stands alone (none). ``source`` false leaves its name out, but in links.
    """

    def change(line: Column) -> Column:
        whole = F.rtrim(line)
        end = F.regexp_extract(whole, LAST_LINK, 0)
        name, url = F.regexp_extract(whole, LAST_LINK, 1), F.regexp_extract(whole, LAST_LINK, 2)
        head = F.rtrim(F.substr(whole, F.lit(1), F.length(whole) - F.length(end)))
        shown = {"hyperlink": F.concat(F.lit("["), name, F.lit("]("), url, F.lit(")")), "plain": F.concat(name, F.lit(" "), url) if source else url, "none": name if source else F.lit("")}[link]
        # An article: its number in brackets, and a dash before the link.
        mark = r"^(\s*)\[(\d+)\]\s+(.*\S)\s+[—–-]$"
        title = F.concat(F.regexp_extract(head, mark, 1), F.concat(F.regexp_extract(head, mark, 2), F.lit(". ")) if numbers else F.lit(""), F.regexp_extract(head, mark, 3))
        article = F.when(shown == "", title).otherwise(F.concat(title, F.lit(" — "), shown))
        # A highlight: a bullet with a bold title, a dash, and what is said of it.
        bullet = r"^(\s*)-\s+\*\*([^*]+)\*\*\s*[—–-]\s*(.*)$"
        told = F.rtrim(F.concat(F.regexp_extract(head, bullet, 1), F.lit("- **"), F.regexp_extract(head, bullet, 2), F.lit("** — "), F.trim(F.regexp_extract(head, bullet, 3))))
        highlight = F.when(shown == "", told).otherwise(F.concat(told, F.lit(" "), shown))
        return F.when((end != "") & head.rlike(mark), article).when((end != "") & head.rlike(bullet), highlight).otherwise(line)

    return _by_line(text, change)


def plain_chat(text: Column, bullet: str = "• ", marker: str = "*") -> Column:
    """Markdown as chat text, line by line: headings and bold between markers, links as their text without the address, bullets."""

    def change(line: Column) -> Column:
        flat = F.regexp_replace(line, r"\[([^\]]+)\]\([^)\s]*\)", "$1")
        flat = F.regexp_replace(flat, r"\*\*(.+?)\*\*", f"{marker}$1{marker}")
        flat = F.when(flat.rlike(r"^\s*[-*]\s"), F.concat(F.lit(bullet), F.regexp_replace(flat, r"^\s*[-*]\s+", ""))).otherwise(flat)
        heading = r"^\s*" + HEADING[1:]
        return F.when(line.rlike(heading), F.concat(F.lit(marker), F.trim(F.regexp_extract(line, heading, 1)), F.lit(marker))).otherwise(flat)

    return _by_line(text, change)


#: What heads the list of a theme's articles in a brief.
ARTICLES = "*Articles:*"


def without_sources(briefs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) without article lists, numbers in brackets and links, for a second language.

    A list is its head and the numbered lines right after it. Any other line
    ends it; so lines between such ends are a run, and of a run what follows a
    head goes: a running flag over the lines' order. Three line breaks and more become two.
    """
    lines = briefs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    flat = F.regexp_replace("line", r"^\s+|\s+$", "")
    head, entry = F.startswith(flat, F.lit(ARTICLES)), flat.rlike(r"^\[\d+\]")
    order = Window.partitionBy(id_col).orderBy("at")
    lines = lines.withColumn("head", head).withColumn("entry", entry & ~head)
    lines = lines.withColumn("run", F.sum((~F.col("head") & ~F.col("entry")).cast("int")).over(order))
    listed = F.max("head").over(Window.partitionBy(id_col, "run").orderBy("at"))
    kept = lines.withColumn("listed", listed).where(~F.col("head") & ~(F.col("entry") & F.col("listed")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n")
    out = briefs.select(id_col).join(kept.groupBy(id_col).agg(text.alias("text")), id_col, "left").withColumn("text", F.coalesce("text", F.lit("")))
    bare = F.regexp_replace(F.regexp_replace("text", r"\s*\[\d+\]", ""), r"\s*\[[^\]]+\]\(https?://[^)]+\)", "")
    return out.select(id_col, F.regexp_replace(F.regexp_replace(bare, "\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"))


#: The rule above a brief's footer, and the heading of its highlights.
FOOTER, HIGHLIGHTS = "---", "## Highlights"


def placed_section(text: Column, section: Column, above_highlights: bool = False) -> Column:
    """The brief with a section above its last footer rule, or above its highlights (without them the first rule); at its end where there is neither.

    A null or empty section changes nothing.
    """
    bare = F.regexp_replace(section, r"\s+$", "")
    end = F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n\n"))

    def at(place: Column, block: Column) -> Column:
        return F.concat(F.substr(text, F.lit(1), place - 1), block, F.substr(text, place))

    if above_highlights:
        block = F.concat(bare, F.lit("\n\n"))
        heading, rule = F.instr(text, F.lit(HIGHLIGHTS)), F.regexp_instr(text, F.lit(rf"(?m)^{FOOTER}\s*$"))
        made = F.when(heading > 0, at(heading, block)).when(rule > 0, at(rule, block)).otherwise(F.concat(end, bare))
    else:
        # The rule's line reads the same backwards, so its last place is its first in the reversed text.
        line = f"\n{FOOTER}\n"
        back = F.instr(F.reverse(text), F.lit(line))
        place = F.length(text) - back - len(line) + 2
        made = F.when(back > 0, at(place, F.concat(F.lit("\n\n"), section, F.lit("\n")))).otherwise(F.concat(end, section, F.lit("\n")))
    return F.when(F.coalesce(section, F.lit("")) == "", text).otherwise(made)


def digest_blocks(articles: DataFrame, clusters: DataFrame, hypotheses: DataFrame, key: str, chars: int = 600) -> DataFrame:
    """(key, block): a brief's clusters as text for a model, in order of rank, their articles in order of ``at``.

    articles: key, cluster_rank, at, id, url, name, title, published_at, relevance, actionability, topics,
    reasoning, matches (array of id, alignment), body; clusters: key, cluster_rank, coverage, where ``left`` and
    ``right`` mark one-sided ones; hypotheses: id, topic, stance. Matches of unknown hypotheses are left out.
    """
    own = [key, "cluster_rank", "at", "id"]
    met = articles.select(*own, F.posexplode("matches").alias("n", "m")).select(*own, "n", F.col("m.id").alias("h"), F.col("m.alignment").alias("alignment"))
    met = met.join(sized(hypotheses.select(F.col("id").alias("h"), "topic", "stance")), "h")
    said = F.format_string("matches '%s' (stance %s), alignment %+d", "topic", "stance", F.col("alignment").cast("int"))
    met = met.groupBy(*own).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), "; ").alias("hypotheses"))
    shown = lambda c, none="": F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none))
    fields = {
        "url": shown("url"), "source": shown("name", "Unknown"), "title": shown("title"), "published": F.coalesce(F.date_format("published_at", "yyyy-MM-dd HH:mm"), F.lit("")), "relevance": shown("relevance", "none"),
        "actionability": shown("actionability", "none"), "topics": F.array_join(F.coalesce("topics", F.array().cast("array<string>")), ", "), "reasoning": shown("reasoning", "(none)"),
        "hypotheses": shown("hypotheses", "none"), "snippet": F.translate(F.substring(F.coalesce("body", F.lit("")), 1, chars), "\n", " "),
    }
    text = F.concat_ws("\n", F.lit("Article:"), *[F.concat(F.lit(f"  {name}: "), value) for name, value in fields.items()])
    rows = articles.join(met, own, "left").select(key, "cluster_rank", F.struct("at", "id", text.alias("s")).alias("x"))
    body = rows.groupBy(key, "cluster_rank").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n").alias("body"))
    body = body.join(clusters.select(key, "cluster_rank", "coverage"), [key, "cluster_rank"], "left")
    tag = F.when(F.col("coverage").isin("left", "right"), F.concat(F.lit(" [one-sided coverage: "), "coverage", F.lit("]"))).otherwise("")
    head = F.concat(F.lit("=== Cluster "), F.col("cluster_rank").cast("string"), F.lit(" ("), F.col("n").cast("string"), F.lit(" articles)"), tag, F.lit(" ==="))
    parts = F.array_sort(F.collect_list(F.struct("cluster_rank", F.concat(head, F.lit("\n\n"), "body").alias("s"))))
    return body.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["s"]), "\n\n").alias("block"))


def chunk_sections(text: Column, limit: int) -> Column:
    """Chunks of up to ``limit`` characters, cut before ``## `` headings; a longer section is cut hard, on its own."""
    parts = F.filter(F.split(text, r"(?m)(?=^##\s)"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(s: Column, part: Column) -> Column:
        whole = F.filter(F.array(s["now"]), lambda x: x != "")
        cut = F.regexp_extract_all(part, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0))
        fits = F.length(s["now"]) + F.length(part) <= limit
        done = F.when(F.length(part) > limit, F.concat(s["done"], whole, cut)).when(fits, s["done"]).otherwise(F.concat(s["done"], whole))
        return F.struct(done.alias("done"), F.when(F.length(part) > limit, F.lit("")).when(fits, F.concat(s["now"], part)).otherwise(part).alias("now"))

    folded = F.aggregate(parts, start, step, lambda s: F.concat(s["done"], F.filter(F.array(s["now"]), lambda x: x != "")))
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(folded)
