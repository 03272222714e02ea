"""Review of highlights: status, filter, sorts, tallies; and the small rules of library rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CONFIDENT, AMBIGUOUS, ORPHAN = "confident", "ambiguous", "orphan"


def entry_status(present: Column, resolution: Column) -> Column:
    """A highlight without an article is an orphan; else what its quote was resolved to."""
    return F.when(~present, ORPHAN).when(resolution.isin(AMBIGUOUS, ORPHAN), resolution).otherwise(CONFIDENT)


def review_filter(rows: DataFrame, tags: Column, article: Column, status: Column, tag: str | None = None, article_id: object = None, confidence: str = "all") -> DataFrame:
    """All given filters together; a tag filter drops entries without an article (tags null)."""
    keep = F.lit(True)
    if tag is not None:
        keep = keep & F.coalesce(F.array_contains(tags, tag), F.lit(False))
    if article_id is not None:
        keep = keep & article.eqNullSafe(F.lit(article_id))
    if confidence != "all":
        keep = keep & (status == confidence)
    return rows.filter(keep)


def ranked_sections(rows: DataFrame, section: str, order: list[Column]) -> DataFrame:
    """Adds place: the entry's position in its section, from 0, by the given order."""
    return rows.withColumn("place", (F.row_number().over(W.partitionBy(section).orderBy(*order)) - 1).cast("long"))


def with_section_newest(rows: DataFrame, section: str, at: str) -> DataFrame:
    """Adds newest: the largest `at` of the section, from an aggregate that is combined before its shuffle."""
    newest = rows.groupBy(F.col(section).alias("_s")).agg(F.max(at).alias("newest"))
    return rows.join(newest, F.col(section).eqNullSafe(F.col("_s"))).drop("_s")


def tally(rows: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    """Counts of the three states; unresolved is all that is not confident."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in (CONFIDENT, AMBIGUOUS, ORPHAN)]
    return rows.groupBy(*group).agg(*counts, F.count_if(F.col(status) != CONFIDENT).alias("unresolved"))


def not_a_chapter(book: Column) -> Column:
    return book.isNull() | (book == "")


def progress_ratio(offset: Column, total: Column) -> Column:
    """0 to 1; 0 where there is no text."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), offset / total))).otherwise(F.lit(0.0))


def with_new_tag(tags: Column, draft: Column) -> Column:
    """The tags with the trimmed draft at the end, unless it is blank or already there (case counts)."""
    tag = F.trim(draft)
    return F.when((tag == "") | F.array_contains(tags, tag), tags).otherwise(F.array_append(tags, tag))


def saved_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: F.trim(t) != "")


# How a source is shown.
BADGES = {"fixture": "Sample", "url": "Web", "paste": "Pasted", "markdown": "Markdown", "html-upload": "HTML file", "pdf": "PDF", "epub-chapter": "Book"}


def source_badge(source: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, label in BADGES.items():
        out = F.when(source == name, label).otherwise(out)
    return out


# What a reader is told for a reason of failure; all others get the last.
FAILURE_COPY = {
    "This address points somewhere the reader can't reach.": ("ssrf-blocked-scheme", "ssrf-blocked-private-ip", "ssrf-blocked-metadata"),
    "Couldn't reach this page.": ("fetch-failed",),
    "This page is too large.": ("response-too-large",),
    "This page isn't an article.": ("unsupported-content-type",),
    "Couldn't reliably read this page.": ("extraction-unsupported", "extraction-too-low-confidence", "round-trip-anchor-failed"),
    "This PDF couldn't be opened — it may be corrupt or not a PDF.": ("pdf-unreadable",),
    "This PDF is password-protected, so its text can't be read.": ("pdf-encrypted",),
    "This PDF looks like scanned images rather than text. An OCR tool could convert it first.": ("pdf-scanned",),
    "This PDF has multiple text columns, and its reading order can't be reconstructed reliably yet.": ("pdf-multi-column",),
    "This PDF is too long or too large to read here.": ("pdf-too-large",),
    "This book is protected by DRM and cannot be added.": ("epub-protected",),
    "This file could not be read as an EPUB book.": ("epub-unreadable",),
    "No readable chapters were found in this book.": ("epub-empty",),
    "This book is too large to add.": ("epub-too-large",),
    "Already in your library.": ("already-in-library",),
}
OTHER_FAILURE = "Something went wrong. Try again."


def failure_copy(reason: Column) -> Column:
    out = F.lit(OTHER_FAILURE)
    for text, reasons in FAILURE_COPY.items():
        out = F.when(reason.isin(*reasons), text).otherwise(out)
    return out


def drm_protected(names: Column, algorithms: Column, font_algorithm: str = "http://www.idpf.org/2008/embedding") -> Column:
    """A licence or rights file, or any encryption that is not font obfuscation."""
    marked = F.array_contains(names, "META-INF/license.lcpl") | F.array_contains(names, "META-INF/rights.xml")
    foreign = F.exists(F.coalesce(algorithms, F.array().cast("array<string>")), lambda a: F.coalesce(a != font_algorithm, F.lit(True)))
    return F.coalesce(marked, F.lit(False)) | foreign


# Titles that a writing program made up.
TITLE_GARBAGE = (
    r"^\s*$", r"(?i)^(untitled|unknown|title|document|new document|presentation|slide 1|layout)\s*$", r"(?i)^microsoft (word|powerpoint|excel|office)\b",
    r"(?i)^adobe (acrobat|illustrator)\b", r"(?i)\.(docx?|pptx?|pdf|indd|qxd|pub|pages)$", r"(?i)^[0-9a-f]{16,}$", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)


def sane_title(title: Column) -> Column:
    t = F.trim(title)
    good = F.length(t).between(2, 200)
    for pattern in TITLE_GARBAGE:
        good = good & ~t.rlike(pattern)
    return F.coalesce(good, F.lit(False))


def bare_page_number(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"\s+", " ")).rlike(r"^[#|\-–—\s]*[0-9]{1,4}[#|\-–—\s]*$")


def allowed_link(href: Column) -> Column:
    return href.rlike("(?i)^(https?|mailto):")


def allowed_media(src: Column) -> Column:
    return src.rlike("(?i)^https?:")


def selectable(kind: Column) -> Column:
    return kind.isin("paragraph", "heading", "blockquote", "bulleted-list", "numbered-list", "figure", "code-block", "footnote-reference")


def splittable(kind: Column) -> Column:
    return kind.isin("paragraph", "blockquote", "bulleted-list", "numbered-list")


def citation(author: Column, title: Column, url: Column) -> Column:
    core = F.when(F.coalesce(author, F.lit("")) != "", F.concat(author, F.lit(", *"), title, F.lit("*"))).otherwise(F.concat(F.lit("*"), title, F.lit("*")))
    source = F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit(" ([source]("), url, F.lit("))"))).otherwise("")
    return F.concat(F.lit("> — "), core, source)


def match_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[-_\s]+", " "))


def duplicates_title(heading: Column, title: Column) -> Column:
    """Whether a leading heading repeats the title: either contains the other."""
    h, t = match_key(heading), match_key(title)
    return F.coalesce((h != "") & (t != "") & (t.contains(h) | h.contains(t)), F.lit(False))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.(md|markdown|pdf|epub)$", "")


def source_title(title: Column, source: Column, hint: Column, url_host: Column) -> Column:
    """The document's own title, else what its source can say."""
    file = lambda word: F.coalesce(without_extension(hint), F.lit(word))
    fallback = F.when(source == "markdown", file("Markdown document")).when(source == "pdf", file("PDF document")).when(url_host != "", url_host).otherwise("Pasted article")
    return F.coalesce(title, fallback)


def meta_content(html: Column, key: str, name: str) -> Column:
    """content of the first meta element with key="name", trimmed; null if blank or absent. Attributes in either order."""
    quoted = name.replace(".", r"\.")
    one = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*{key}=["']{quoted}["'][^>]*content=["']([^"']*)["']""", 1)
    two = F.regexp_extract(html, rf"""(?is)<meta\s[^>]*content=["']([^"']*)["'][^>]*{key}=["']{quoted}["']""", 1)
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.nullif(F.trim(two), F.lit("")))


def page_language(html: Column) -> Column:
    lang = F.trim(F.regexp_extract(html, r"""(?is)<html\b[^>]*\blang=["']?([^"'\s>]*)""", 1))
    return F.when(lang == "", "en").otherwise(lang)


def page_title(html: Column) -> Column:
    """og:title, else the title element, else the first h1; inline tags of a heading are dropped."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), "<[^>]*>", "")), F.lit(""))
    return F.coalesce(meta_content(html, "property", "og:title"), inner("title"), inner("h1"))


def iso_time(text: Column) -> Column:
    """The time in UTC with milliseconds, null where it is none."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def storage_error(name: Column, message: Column) -> Column:
    """A newer store cannot be used; all else counts as unavailable for now."""
    newer = (name == "VersionError") | message.rlike("(?i)requested version.*less than the existing")
    return F.when(F.coalesce(newer, F.lit(False)), "unupgradeable").otherwise("unavailable")
