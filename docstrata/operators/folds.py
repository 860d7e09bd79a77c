"""Ordered folds W3 (multi-line header merge) and W4 (header grouping).

Both folds run inside one page of one document. The pair tests that do
not depend on the group built so far are taken with ``lag`` first and cut
the page into runs; only the part that depends on the group state (the
anchor size of W3; the size / length caps of W4) is folded, with native
higher-order functions over the run's sorted array. Rows of a hot document
spread over its pages, and no Python runs per row.

A run of up to ``SHORT_RUN`` rows is folded step by step. In a longer one
each row first gets its next break, the row that would begin the next group
if one began here; group starts are the orbit of the first row, and pointer
doubling finds them: in round k every pointer is the 2^k-th next break, and
the starts known so far give as many again. That is n log n for a run of n
rows, without a state that grows by the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip

# Fixed values (reference defaults).
MERGE_MAX_LINE_SPACING = 6.0
MERGE_FONT_SIZE_THRESHOLD = 1.5
GROUP_MAX_ITEMS = 4
GROUP_MAX_CHARS = 300
GROUP_SIZE_TOLERANCE = 0.2
GROUP_MAX_DY = 0.1
GROUP_MAX_SPACING = 30.0
GROUP_SHORT_CHARS = 100
#: Rows of a run that is folded step by step.
SHORT_RUN = 32
#: Stands for no page while rows are joined by page; outside the range of the column.
NO_PAGE = -(1 << 40)
CONTINUATION_PREFIXES = ["and ", "or ", "the ", "of ", "in ", "on ", "with "]


def page_window(order: list[str]) -> Window:
    return Window.partitionBy("doc_id", "page").orderBy(*order)


def key_pages(df: DataFrame) -> DataFrame:
    """``page`` as a long that is never null (``NO_PAGE`` is first in order, as null is), so that
    pages meet in an equality join; ``restore_pages`` takes it back."""
    return df.withColumn("page", F.coalesce(F.col("page").cast("long"), F.lit(NO_PAGE)))


def restore_pages(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumn("page", F.when(F.col("page") != NO_PAGE, F.col("page")).cast(like.schema["page"].dataType))


def by_page(rows: DataFrame, per_doc: DataFrame, source: DataFrame, how: str) -> DataFrame:
    """``rows``, which lie by (doc_id, page) and have ``key_pages``, with the small row ``per_doc``
    of their document. That row is dealt to the document's pages in ``source`` and goes to the
    pages of ``rows``: a join by doc_id would shuffle and sort the wide rows instead."""
    pages = key_pages(source.select("doc_id", "page")).distinct()
    return rows.join(pages.join(per_doc, "doc_id").hint("shuffle_hash"), ["doc_id", "page"], how)


def _run_ids(df: DataFrame, breaks, order: list[str]) -> DataFrame:
    w = page_window(order)
    return df.withColumn(
        "run_id",
        F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )


def merge_runs(blocks: DataFrame, payload: list[str],
               max_line_spacing: float = MERGE_MAX_LINE_SPACING,
               font_size_threshold: float = MERGE_FONT_SIZE_THRESHOLD) -> DataFrame:
    """W3. ``blocks`` has doc_id, page, y0, block_seq, avg_font_size,
    is_bold, is_italic, spacing_above, text and the ``payload`` columns.

    A block joins the open merged block when it is on the same page, its
    size differs from the *anchor's* size by less than the threshold, bold
    and italic equal the anchor's and its own spacing is under the limit.
    The merged block keeps the anchor's fields; text is joined by one
    blank; spacing_above is the minimum.
    Output: one row per merged block with the anchor's columns, merged
    ``text``, merged ``spacing_above`` and ``anchor_text`` (the anchor's own
    text) plus ``n_merged``.
    """
    order = ["y0", "block_seq"]
    w = page_window(order)
    prev_bold = F.lag("is_bold").over(w)
    prev_italic = F.lag("is_italic").over(w)
    breaks = (
        prev_bold.isNull()
        | (prev_bold != F.col("is_bold"))
        | (prev_italic != F.col("is_italic"))
        | ~(F.col("spacing_above") < max_line_spacing)
    )
    runs = _run_ids(blocks, breaks, order)
    fields = ["y0", "block_seq", "avg_font_size", "spacing_above", "text", "is_bold", "is_italic"]
    fields += [c for c in payload if c not in fields]
    packed = runs.groupBy("doc_id", "page", "run_id").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")
    )
    sizes = F.transform("rows", lambda x: x["avg_font_size"])
    packed = packed.withColumn("sizes", sizes).withColumn("starts", F.expr(f"""
        CASE WHEN size(rows) <= {SHORT_RUN} OR exists(sizes, x -> x IS NULL OR isnan(x)) THEN
          aggregate(sizes, named_struct('anchor', CAST(NULL AS DOUBLE), 'i', 0, 'starts', CAST(array() AS ARRAY<INT>)),
            (acc, x) -> CASE
              WHEN acc.anchor IS NULL OR NOT (abs(x - acc.anchor) < {font_size_threshold})
                THEN named_struct('anchor', x, 'i', acc.i + 1, 'starts', array_append(acc.starts, acc.i))
              ELSE named_struct('anchor', acc.anchor, 'i', acc.i + 1, 'starts', acc.starts) END,
            acc -> acc.starts)
        ELSE {_orbit(_next_far("sizes", font_size_threshold))} END"""))
    groups = packed.select("doc_id", "page", F.explode_outer(_slices()).alias("g"))
    keep = [c for c in fields if c not in ("text", "spacing_above")]
    first = F.col("g")[0]
    return groups.select(
        "doc_id", "page",
        *[first[c].alias(c) for c in keep],
        first["text"].alias("anchor_text"),
        F.array_join(F.transform("g", lambda x: x["text"]), " ").alias("text"),
        F.array_min(F.transform("g", lambda x: x["spacing_above"])).alias("spacing_above"),
        F.size("g").cast("int").alias("n_merged"),
    )


def _slices() -> Column:
    """The rows of a run cut at its starts, one array a group."""
    return F.expr("""transform(sequence(0, size(starts) - 1), k -> slice(rows, starts[k] + 1,
        (CASE WHEN k + 1 < size(starts) THEN starts[k + 1] ELSE size(rows) END) - starts[k]))""")


def _next_far(values: str, threshold: float) -> str:
    """SQL: for each element the first later one that differs by the threshold or more
    (the size if none). Tables of the least and greatest of 2^k elements are built by
    doubling; from the largest step down, a step is taken while all in it stay near."""
    levels = f"""aggregate(sequence(1, CAST(ceil(log2(size({values}))) AS INT)), array(named_struct('lo', {values}, 'hi', {values})),
      (t, k) -> concat(t, array(named_struct(
        'lo', transform(element_at(t, -1).lo, (x, i) -> CASE WHEN i + shiftleft(1, k - 1) < size({values})
            THEN least(x, element_at(t, -1).lo[i + shiftleft(1, k - 1)]) ELSE x END),
        'hi', transform(element_at(t, -1).hi, (x, i) -> CASE WHEN i + shiftleft(1, k - 1) < size({values})
            THEN greatest(x, element_at(t, -1).hi[i + shiftleft(1, k - 1)]) ELSE x END)))))"""
    return f"""transform(array({levels}), t ->
      transform({values}, (x, i) -> aggregate(sequence(size(t) - 1, 0, -1), i + 1, (at, k) -> CASE
        WHEN at + shiftleft(1, k) <= size({values}) AND abs(t[k].hi[at] - x) < {threshold} AND abs(t[k].lo[at] - x) < {threshold}
          THEN at + shiftleft(1, k) ELSE at END)))[0]"""


def _orbit(jumps: str) -> str:
    """SQL: the elements met from 0 by following ``jumps`` (larger numbers, the size
    at the end), ascending, by pointer doubling."""
    return f"""transform(array({jumps}), j -> array_sort(aggregate(
      sequence(0, CAST(ceil(log2(size(j))) AS INT)), named_struct('jump', array_append(j, size(j)), 'met', array(0)),
      (acc, k) -> named_struct('jump', transform(acc.jump, x -> acc.jump[x]),
                               'met', array_union(acc.met, filter(transform(acc.met, x -> acc.jump[x]), x -> x < size(j)))),
      acc -> acc.met)))[0]"""


def pair_links(blocks: DataFrame) -> DataFrame:
    """W4 pair test between a block and the one before it on the page
    (everything except the group caps). Adds ``link`` (boolean)."""
    order = ["y0", "block_seq"]
    w = page_window(order)
    blocks = blocks.withColumn("_stripped", strip(F.col("text")))  # once a row: the tests below ask for it many times
    p = {c: F.lag(c).over(w) for c in
         ("avg_font_size", "is_bold", "is_italic", "font_name", "y_position_relative", "_stripped")}
    size, psize = F.col("avg_font_size"), p["avg_font_size"]
    fmt = (
        (F.coalesce(p["is_bold"], F.lit(False)) == F.coalesce(F.col("is_bold"), F.lit(False))).cast("int")
        + (F.coalesce(p["is_italic"], F.lit(False)) == F.coalesce(F.col("is_italic"), F.lit(False))).cast("int")
        + (F.coalesce(p["font_name"], F.lit("")) == F.coalesce(F.col("font_name"), F.lit(""))).cast("int")
    )
    prev_text, curr_text = p["_stripped"], F.col("_stripped")
    starts = None
    for pre in CONTINUATION_PREFIXES:
        t = curr_text.startswith(pre)
        starts = t if starts is None else (starts | t)
    continuation = prev_text.endswith("-") | prev_text.endswith(":") | starts
    short = (F.length(prev_text) <= GROUP_SHORT_CHARS) & (F.length(curr_text) <= GROUP_SHORT_CHARS)
    link = (
        psize.isNotNull()
        & ~(F.abs(psize - size) > F.greatest(psize, size) * GROUP_SIZE_TOLERANCE)
        & (fmt >= 2)
        & ~(F.abs(F.col("y_position_relative") - p["y_position_relative"]) > GROUP_MAX_DY)
        & ~(F.coalesce(F.col("spacing_above"), F.lit(0.0)) > GROUP_MAX_SPACING)
        & (continuation | short)
    )
    return blocks.withColumn("link", F.coalesce(link, F.lit(False))).drop("_stripped")


def group_runs(blocks: DataFrame, max_items: int = GROUP_MAX_ITEMS,
               max_chars: int = GROUP_MAX_CHARS) -> DataFrame:
    """Assign every block a ``group_no`` inside its page.

    Runs of linked blocks are folded for the caps: a new group starts
    when the open one holds ``max_items`` blocks or would exceed
    ``max_chars`` characters. Output: the input rows plus run_id,
    group_no (unique per (doc_id, page)) and pos_in_group."""
    order = ["y0", "block_seq"]
    linked = pair_links(blocks)
    runs = _run_ids(linked, ~F.col("link"), order)
    cols = [c for c in runs.columns if c not in ("doc_id", "page", "run_id", "link")]
    packed = runs.groupBy("doc_id", "page", "run_id").agg(
        F.sort_array(F.collect_list(F.struct("y0", "block_seq", *[c for c in cols if c not in ("y0", "block_seq")]))).alias("rows")
    )
    # the group that would begin at a row takes the rows after it while the caps allow
    jumps = f"""transform(lens, (n, i) -> i + aggregate(sequence(1, {max_items}), named_struct('w', 1, 'tot', n, 'open', true),
      (acc, k) -> CASE WHEN acc.open AND k < {max_items} AND i + k < size(lens) AND acc.tot + lens[i + k] <= {max_chars}
        THEN named_struct('w', acc.w + 1, 'tot', acc.tot + lens[i + k], 'open', true)
        ELSE named_struct('w', acc.w, 'tot', acc.tot, 'open', false) END,
      acc -> acc.w))"""
    packed = packed.withColumn("lens", F.expr("transform(rows, x -> length(x.text))")).withColumn("starts", F.expr(f"""
        CASE WHEN size(rows) <= {SHORT_RUN} OR exists(lens, x -> x IS NULL) THEN
          aggregate(lens, named_struct('n', 0, 'tot', 0, 'i', 0, 'starts', CAST(array() AS ARRAY<INT>)),
            (acc, x) -> CASE WHEN acc.i = 0 OR acc.n >= {max_items} OR acc.tot + x > {max_chars}
              THEN named_struct('n', 1, 'tot', x, 'i', acc.i + 1, 'starts', array_append(acc.starts, acc.i))
              ELSE named_struct('n', acc.n + 1, 'tot', acc.tot + x, 'i', acc.i + 1, 'starts', acc.starts) END,
            acc -> acc.starts)
        ELSE {_orbit(jumps)} END"""))
    gids = F.expr("""flatten(transform(sequence(0, size(starts) - 1), k -> array_repeat(k,
        (CASE WHEN k + 1 < size(starts) THEN starts[k + 1] ELSE size(rows) END) - starts[k])))""")
    out = packed.select(
        "doc_id", "page", "run_id",
        F.posexplode_outer(F.arrays_zip("rows", gids.alias("gids"))).alias("pos", "z"),
    )
    return out.select(
        "doc_id", "page", "run_id",
        F.col("z.gids").alias("gid"),
        *[F.col(f"z.rows.{c}").alias(c) for c in ["y0", "block_seq", *[c for c in cols if c not in ("y0", "block_seq")]]],
    )
