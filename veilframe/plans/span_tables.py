"""Span tables: one row per span, for texts and term lists too large for one expression."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.cuts import safe_cut
from veilframe.functions.spans import NO_SPANS, SPAN_TYPE, gathered, match_offsets, resolve_overlaps, shifted
from veilframe.functions.sqltext import ident
from veilframe.functions.text import sections
from veilframe.operators.detect import spans_sql
from veilframe.operators.overlaps import settled_run
from veilframe.operators.recognizers import CONTEXT_CHARS, Recognizer, RecognizerRegistry

# A term's words: letters of any script, digits and the marks names are written with.
TOKEN = r"[\p{L}\p{N}_#'-]+"
# No term holds such a character, so texts are cut there.
OUTSIDE_TERMS = r"[^\p{L}\p{N}_#'\- ]"
SECTION_CHARS = 5000
# A term list is broadcast up to this size; each entry is counted with the overhead of a hash row.
BROADCAST_BYTES = 32 * 1024 * 1024
TERM_OVERHEAD = 64


def _sectioned(
    df: DataFrame, text_col: str, id_cols: Sequence[str], section_chars: int, cut: str | None
) -> DataFrame:
    """One row per section: where it starts, its text and the characters before it."""
    t = ident(text_col)
    cuts = sections(t, max(section_chars, CONTEXT_CHARS), cut) if cut else f"array({t})"
    placed = gathered(
        "pieces", "struct<base:int,piece:string>", "struct(acc.at as base, v as piece)", lambda at: f"{at} + char_length(v)")
    cut_up = df.where(f"{t} is not null").select(*id_cols, F.expr(f"explode(array({cuts}))").alias("pieces"))
    leads = "concat(array(''), transform(slice(pieces, 1, greatest(size(pieces) - 1, 0)), p -> right(p, {})))"
    pairs = f"zip_with({placed}, {leads.format(CONTEXT_CHARS)}, (p, lead) -> struct(p.base as base, p.piece as piece, lead as lead))"
    return cut_up.where("size(pieces) > 0").select(*id_cols, F.explode(F.expr(pairs)).alias("p")).select(*id_cols, "p.*")


def cut_for(recognizers: Iterable[Recognizer]) -> str | None:
    """A pattern for the places where a text can be cut without cutting a match of these recognizers; None if there are none."""
    listed = list(recognizers)
    cut = safe_cut(p for r in listed for p in r.regexes)
    # No built-in pattern matches a line feed, whatever else it holds.
    return cut or ("\\n" if all(r.line_bounded for r in listed) else None)


def detect_long(
    df: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    *,
    section_chars: int = SECTION_CHARS,
    spread: int | None = None,
    registry: RecognizerRegistry | None = None,
    entities: Sequence[str] | None = None,
    language: str | None = "en",
    score_threshold: float = 0.4,
) -> DataFrame:
    """The span table of long texts, found section by section; same spans as on the whole text.

    Sections end where, by the syntax of the selected patterns, no match can cross, so no span is cut and
    overlaps settle inside one section: for the built-in patterns at line feeds, quotes and brackets, and at blanks
    before small letters.  Custom patterns take part; if one cannot be read (anchors, Java-only syntax), texts stay whole.
    ``spread`` redistributes the sections over that many partitions, for inputs where a few huge
    texts sit in one.
    """
    registry = registry or RecognizerRegistry()
    chosen = registry.select(entities, language, score_threshold)
    parts = _sectioned(df, text_col, id_cols, section_chars, cut_for(chosen))
    if spread:
        parts = parts.repartition(spread, *id_cols, "base")
    found = spans_sql(
        "piece", registry, entities=entities, language=language, score_threshold=score_threshold,
        lead="lead", resolve=False,
    )
    raw = parts.select(*id_cols, "base", F.expr(f"explode(array({found}))").alias("found")).where("size(found) > 0")
    spans = F.expr(shifted(resolve_overlaps("found"), "base"))
    return raw.select(*id_cols, F.explode(spans).alias("s")).select(*id_cols, "s.*")


def term_spans(
    df: DataFrame,
    text_col: str,
    id_cols: Sequence[str],
    terms: DataFrame,
    *,
    score: float = 0.6,
    max_words: int | None = None,
    term_bytes: int | None = None,
    capitalised: bool = True,
    salts: int = 16,
) -> DataFrame:
    """Spans of the words and phrases listed in ``terms(term, entity_type)``.

    Word n-grams are joined to the table on equality; what is shuffled is words, never texts.  The
    list is broadcast if its measured size allows.  A larger one is shuffled and every term repeated
    for ``salts`` salts, so a word that makes up a large share of all words is spread over as many
    tasks.  ``id_cols`` must identify a text.  The list is measured by a job, unless the caller states both
    the number of words in its longest term (a longer term is then an error, not lost) and its size.
    """
    listed = terms.select("term", "entity_type").distinct()
    words = F.size(F.split("term", " "))
    if max_words is None or term_bytes is None:
        size = listed.agg(
            F.max(words).alias("words"),
            F.sum(F.octet_length("term") + F.octet_length("entity_type") + TERM_OVERHEAD).alias("bytes"),
        ).first()
        term_bytes = (size["bytes"] or 0) if term_bytes is None else term_bytes
        max_words = max(max_words or 1, int(size["words"] or 1))
    else:
        told = F.format_string("the term %s has more words than max_words", "term")
        listed = listed.withColumn("term", F.when(words > max_words, F.raise_error(told)).otherwise(F.col("term")))
    small = term_bytes <= BROADCAST_BYTES
    parts = _sectioned(df, text_col, id_cols, SECTION_CHARS, OUTSIDE_TERMS)
    tokens = parts.select(
        *id_cols, "base", "piece", F.expr(f"explode(array({match_offsets('piece', TOKEN)}))").alias("w")
    )
    first = "filter({0}, g -> rlike(substring(g.text, 1, 1), '\\\\p{{Lu}}'))" if capitalised else "{0}"
    grams = [first.format("w")]
    for n in range(2, max_words + 1):
        # The n-gram starting at word i ends at word i + n - 1; all gaps must be one space.
        grams.append(first.format(
            f"filter(zip_with(w, slice(w, {n}, greatest(size(w), 1)), (a, b) -> "
            "struct(a.start as start, b.end as end, substring(piece, a.start + 1, "
            "b.end - a.start) as text)), g -> g.end is not null and "
            f"size(split(g.text, ' ')) = {n} and g.text not rlike '[^\\\\p{{L}}\\\\p{{N}}_#\\'\\\\- ]')"
        ))
    every = grams[0] if len(grams) == 1 else f"concat({', '.join(grams)})"
    rows = tokens.select(*id_cols, "base", F.explode(F.expr(every)).alias("g"))
    if small:
        joined = rows.join(F.broadcast(listed), F.col("g.text") == F.col("term"))
    else:
        salted = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        spread = rows.withColumn("row_salt", F.pmod(F.xxhash64(*id_cols, "base", "g.start"), F.lit(salts)))
        on = (F.col("g.text") == F.col("term")) & (F.col("row_salt") == F.col("salt"))
        # Spark's estimate does not count the copies made by the salts, so left alone it may broadcast them all.
        joined = spread.join(salted.hint("merge"), on)
    hits = joined.select(
        *id_cols,
        (F.col("g.start") + F.col("base")).alias("start"),
        (F.col("g.end") + F.col("base")).alias("end"),
        "entity_type",
        F.lit(float(score)).alias("score"),
        F.col("g.text").alias("text"),
    )
    return resolve_table(hits, id_cols)


def resolve_table(spans: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Overlap resolution on a span table.

    Spans are cut into runs of chained overlaps by a running maximum of the ends, and each run is
    settled on its own; the shuffle carries spans only.  Most spans overlap no other: they are runs of
    their own, which nothing has to be gathered for.
    """
    by_start = Window.partitionBy(*id_cols).orderBy("start", "end", "entity_type")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce((F.max("end").over(before) <= F.col("start")).cast("int"), F.lit(1))
    marked = spans.withColumn("_opens", opens).withColumns({
        "_run": F.sum("_opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)),
        "_alone": (F.col("_opens") == 1) & (F.lead("_opens", 1, 1).over(by_start) == 1),
    })
    fields = [p.split(":")[0] for p in SPAN_TYPE[len("struct<"):-1].split(",")]
    alone = marked.where("_alone").select(*id_cols, *fields)
    runs = marked.where("not _alone").groupBy(*id_cols, "_run").agg(F.collect_list(F.struct(*fields)).alias("run"))
    # One-row explode: without it the choice is worked out anew for each condition that the optimizer makes of the next step.
    kept = runs.select(*id_cols, F.explode(F.array(settled_run("run"))).alias("run")).select(*id_cols, F.explode("run").alias("s"))
    return alone.unionByName(kept.select(*id_cols, *(f"s.{f}" for f in fields)))


def collect_spans(
    spans: DataFrame, id_cols: Sequence[str], texts: DataFrame | None = None
) -> DataFrame:
    """Back to one row per text: the start-ordered span array.

    A span table knows only texts with spans; with ``texts`` the result has a row for every row of it,
    an empty array where nothing was found, and its other columns.
    """
    fields = [p.split(":")[0] for p in SPAN_TYPE[len("struct<"):-1].split(",")]
    grouped = spans.groupBy(*id_cols).agg(F.collect_list(F.struct(*fields)).alias("spans"))
    grouped = grouped.withColumn("spans", F.array_sort("spans"))
    if texts is None:
        return grouped
    joined = texts.join(grouped, list(id_cols), "left")
    return joined.withColumn("spans", F.coalesce("spans", F.expr(NO_SPANS)))
