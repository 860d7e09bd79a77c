"""SRC2: markup as layout. A stack fold over tag events gives blocks, lines and spans.

A page is cut into events (tags, texts) by one regex. The fold keeps the stack
of open tags and the running numbers of block and line:

* a tag opens: block tags begin a block and close an open ``p``; ``li`` closes an
  open ``li`` of its list; ``br`` begins a line; others are pushed alone;
* a tag closes: the stack is cut at its last opening, with all that is above it
  (nothing happens if it is not open); block tags end the block;
* a text is a span: its size comes from the innermost open tag that has one, bold
  and italic from any open tag, its block and line from the running numbers.

Comments, scripts, styles and images give nothing; so do blank texts.

The fold is native and in two levels: events are cut into chunks, spans are
appended inside a chunk and chunks to a list, so that a page of n events
costs n * CHUNK / 2 + (n / CHUNK)^2 / 2 copied references, not n^2 / 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags and the sizes that stand for them (FIXTURES.md V2, V9).
SIZES = {"title": 24.0, "h1": 20.0, "h2": 18.0, "h3": 16.0, "h4": 14.0, "h5": 12.0, "h6": 11.0, "b": 14.0, "p": 11.0, "li": 10.0,
         "a": 10.0, "div": 10.0, "footer": 9.0}
DEFAULT_SIZE = 11.0
BLOCK_TAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "ul", "ol", "div", "nav", "article", "section", "header", "footer", "body",
              "head", "html", "table", "tr", "td", "th", "blockquote", "pre")
VOID_TAGS = ("br", "img", "hr", "input", "meta", "link", "source", "wbr")
BOLD_TAGS = ("b", "strong", "title", "h1", "h2", "h3", "h4", "h5", "h6")
ITALIC_TAGS = ("i", "em", "cite")
EVENT = r"(?i)<!--[\s\S]*?-->|<script[\s\S]*?</script>|<style[\s\S]*?</style>|</?[a-z][^>]*>|<![^>]*>|[^<]+"
#: Events of a chunk.
CHUNK = 256
#: Height of a block and of the margin in points; the page is as high as its blocks.
STEP, MARGIN, WIDTH = 20.0, 40.0, 612.0


def _list(names) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


_SIZE_MAP = "map(" + ", ".join(f"'{k}', {v}D" for k, v in SIZES.items()) + ")"
_LAST = "(CASE WHEN array_contains({s}, {t}) THEN size({s}) - array_position(reverse({s}), {t}) + 1 ELSE 0 END)"


def _last(stack: str, tag: str) -> str:
    """SQL: place of a tag's last opening in the stack, 0 if it is not open."""
    return _LAST.format(s=stack, t=tag)


# the stack after the implied ends of an opening tag, and after the tag itself
_IMPLIED = f"""CASE
  WHEN e.tag = 'li' AND {_last('a.stack', "'li'")} > greatest({_last('a.stack', "'ul'")}, {_last('a.stack', "'ol'")}) THEN slice(a.stack, 1, CAST({_last('a.stack', "'li'")} - 1 AS INT))
  WHEN e.tag <> 'li' AND array_contains({_list(BLOCK_TAGS)}, e.tag) AND array_contains(a.stack, 'p') THEN slice(a.stack, 1, CAST({_last('a.stack', "'p'")} - 1 AS INT))
  ELSE a.stack END"""
_STACK = f"""CASE e.kind
  WHEN 'open' THEN CASE WHEN array_contains({_list(VOID_TAGS)}, e.tag) THEN a.stack ELSE array_append({_IMPLIED}, e.tag) END
  WHEN 'close' THEN CASE WHEN array_contains(a.stack, e.tag) THEN slice(a.stack, 1, CAST({_last('a.stack', 'e.tag')} - 1 AS INT)) ELSE a.stack END
  ELSE a.stack END"""
_EDGE = f"(e.kind = 'open' OR e.kind = 'close' AND array_contains(a.stack, e.tag)) AND array_contains({_list(BLOCK_TAGS)}, e.tag)"
_SPAN = f"""named_struct('block', a.block, 'line', a.line, 'text', e.text,
  'size', coalesce(element_at({_SIZE_MAP}, element_at(filter(a.stack, t -> map_contains_key({_SIZE_MAP}, t)), -1)), {DEFAULT_SIZE}D),
  'bold', arrays_overlap(a.stack, {_list(BOLD_TAGS)}), 'italic', arrays_overlap(a.stack, {_list(ITALIC_TAGS)}))"""
_SPANS = "array<struct<block:int,line:int,text:string,size:double,bold:boolean,italic:boolean>>"
_STEP = f"""named_struct('stack', {_STACK},
  'block', a.block + CASE WHEN {_EDGE} THEN 1 ELSE 0 END,
  'line', CASE WHEN {_EDGE} THEN 0 WHEN e.kind = 'open' AND e.tag = 'br' THEN a.line + 1 ELSE a.line END,
  'spans', CASE WHEN e.kind = 'text' THEN array_append(a.spans, {_SPAN}) ELSE a.spans END)"""
_FOLD = f"""flatten(aggregate(chunks,
  named_struct('stack', CAST(array() AS ARRAY<STRING>), 'block', 0, 'line', 0, 'done', CAST(array() AS ARRAY<{_SPANS}>)),
  (o, chunk) -> aggregate(chunk, named_struct('stack', o.stack, 'block', o.block, 'line', o.line, 'spans', CAST(array() AS {_SPANS})),
    (a, e) -> {_STEP},
    a -> named_struct('stack', a.stack, 'block', a.block, 'line', a.line, 'done', array_append(o.done, a.spans))),
  o -> o.done))"""


def markup_events(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, events): tags and texts of each page in order, ``kind`` open, close or text."""
    tokens = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(EVENT), F.lit(0))
    name = "lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1))"
    rows = pages.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"))
    events = F.expr(f"""filter(transform(tokens, t -> named_struct(
        'kind', CASE WHEN t NOT LIKE '<%' THEN CASE WHEN trim(BOTH ' \t\n\r' FROM t) = '' THEN '' ELSE 'text' END
                     WHEN t RLIKE '(?i)^<(!|script|style)' THEN '' WHEN t LIKE '</%' THEN 'close' ELSE 'open' END,
        'tag', {name}, 'text', t)), e -> e.kind <> '')""")
    return rows.select("doc_id", events.alias("events"))


def markup_spans(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", chunk: int = CHUNK) -> DataFrame:
    """D1 spans of marked-up pages, one page a document: block after block from the top."""
    rows = markup_events(pages, id_col, html_col)
    cut = F.expr(f"transform(sequence(0, greatest(0, CAST((size(events) - 1) DIV {chunk} AS INT))), k -> slice(events, k * {chunk} + 1, {chunk}))")
    rows = rows.select("doc_id", cut.alias("chunks")).select("doc_id", F.expr(_FOLD).alias("spans"))
    # The outer form: a plain explode makes the optimizer repeat the fold in a filter.
    rows = rows.select("doc_id", (F.try_element_at("spans", F.lit(-1))["block"] + 1).alias("n"), F.posexplode_outer("spans").alias("span_seq", "s"))
    rows = rows.filter(F.col("s").isNotNull())
    top = F.lit(MARGIN) + F.col("s.block") * STEP
    font = F.concat(F.lit("Helvetica"), F.when(F.col("s.bold") & F.col("s.italic"), "-BoldItalic").when(F.col("s.bold"), "-Bold").when(
        F.col("s.italic"), "-Italic").otherwise(""))
    return rows.select(
        "doc_id", F.lit(1).alias("page"), F.col("s.block").alias("block_seq"), F.col("s.line").alias("line_seq"), "span_seq",
        F.col("s.text").alias("text"), font.alias("font"), F.col("s.size").alias("size"),
        (F.when(F.col("s.bold"), 16).otherwise(0) + F.when(F.col("s.italic"), 2).otherwise(0)).cast("int").alias("flags"), F.lit(0).alias("color"),
        F.lit(72.0).alias("bx0"), top.alias("by0"), F.lit(540.0).alias("bx1"), (top + (STEP - 4)).alias("by1"),
        F.lit(WIDTH).alias("page_width"), (F.col("n") * STEP + 2 * MARGIN).alias("page_height"))
