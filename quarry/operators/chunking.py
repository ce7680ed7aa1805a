"""Pages to chunks, chunk tags, sections."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import models

SIZE, STEP, SHORT, MOST = 600, 480, 200, 1200
#: Words that a chunk begins with when a sentence was cut before it, and what may hang on to them.
# fixed values
CONJUNCTIONS = "and but or however therefore thus moreover furthermore additionally also meanwhile 并 并且 而且 但是 然而 因此 所以 此外 另外 同时 以及 还有".split()
EDGES = "，。！？.!?；;…,、:："
CAPTION = r"(?m)^\s*(?:(?i:table|figure|fig\.)\s*\d+|[表图]\s*\d+)"
# fixed values: numerals, what parts them from a title, and what a title begins with
CHINESE, ROMAN, ENGLISH, ANY_TITLE = "[一二三四五六七八九十]", "[MDCLX]*(?:IX|IV|V?I{1,3})", r"[A-Za-z][^\n]{0,80}", r"[^\n]{0,80}"
NUMBERED = (
    (r"\d+", r"[. \t、．]", r"[A-Za-z\x{4e00}-\x{9fff}][^\n]{0,80}"),
    (f"{CHINESE}+", "[、．]", ANY_TITLE),
    (ROMAN, r"[. \t、]", ENGLISH),
    (r"(?i:chapter|ch\.)[ \t]*\d+", r"[. \t:、]", ENGLISH),
    (r"§[ \t]*\d+", r"[. \t、]", ENGLISH),
)
BARE = (
    r"(?i:introduction|methods?|methodology|results?|discussion|conclusion|references|bibliography|appendix|appendices|acknowledgments?|supplementary|supporting\s+information)",
    "(?:引言|绪论|研究方法|方法|结果|结果与分析|结果与讨论|讨论|结论|总结|参考文献|附录|致谢|摘要)",
)
SUBNUMBERED = (
    (r"\d+\.\d+(?:\.\d+)?", r"[. \t、]", ANY_TITLE),
    (rf"[（(](?:{CHINESE}|\d)+[）)]", "", ANY_TITLE),
    ("[①②③④⑤⑥⑦⑧⑨⑩]", "", ANY_TITLE),
    ("[A-F]", r"[. \t、]", ENGLISH),
)
#: Numbers alone, which head a section where an item has no other headings.
ALONE = (r"^\s*(\d+(?:\.\d+)*)[.\s、．]?\s*$", f"^\\s*({CHINESE}+)[、．]?\\s*$", rf"^\s*[（(]((?:{CHINESE}|\d)+)[）)]\s*$", rf"^\s*({ROMAN})\s*[.\s、]?\s*$")
# fixed values: section types by the first whose words a heading contains
SECTION_TYPES = {
    "abstract": "abstract|摘要|a b s t r a c t",
    "introduction": "intro|引言|绪论|背景|background|问题提出|问题的提出|研究意义|theoretical framework|理论框架|conceptual framework|概念框架|研究假设|hypothesis|hypotheses|理论基础",
    "literature_review": "literature|related work|文献综述|研究综述|前人研究|文献回顾|已有研究|国内外研究",
    "methods": "method|方法|实验设计|数据|data|study area|研究区|材料|material|样本|sample|empirical strategy|empirical framework|empirical approach|实证策略|实证框架|模型设定|模型构建|计量模型|变量定义|变量选择|变量说明|identification|estimation|研究设计|research design|case study|案例分析|survey|问卷|调查设计|measurement|测量",
    "results": "result|finding|结果|analysis|实证分析|descriptive statistics|描述性统计|基准回归|robustness|稳健性|内生性|endogeneity|异质性|heterogeneity|机制分析|mechanism|进一步分析",
    "discussion": "discussion|讨论|implication|policy recommendations|建议|政策启示|政策含义|对策|研究启示|管理启示|实践启示",
    "conclusion": "conclusion|结论|总结|concluding|summary|结语|结束语|研究不足|limitations|研究局限|未来研究|future research",
    "references": "reference|bibliography|文献|注释",
    "appendix": "appendix|appendices|附录|附表|附图|supplementary|supporting information|附件",
    "acknowledgments": "acknowledgment|acknowledgement|致谢|感谢|基金项目|资助",
}


def sliding(pages: DataFrame, size: int = SIZE, step: int = STEP, short: int = 0) -> DataFrame:
    """pages (item_key, text) to windows (item_key, chunk_idx, text): of `size` characters each `step`, stripped; the last is the first that reaches the end. Blank windows are dropped.

    A last window below `short` characters joins the one before, with a blank line, as `merge_short` has it; here it needs
    no shuffle, since a page's windows are made together."""
    body = F.concat(F.col("text"), F.lit("\n"))

    def cut(body: Column) -> Column:
        # a place in a string is found from its start, so long texts are cut into parts of some windows first
        n = F.greatest(F.lit(1), F.ceil((F.length(body) - size) / step) + 1).cast("int")
        group = F.ceil(F.sqrt(n)).cast("int")

        def windows(first: Column) -> Column:
            last = F.least(first + group, n) - 1
            part = F.substr(body, first * step + 1, group * step + size)
            return T.let(part, lambda p: F.transform(F.sequence(first, last), lambda k: F.struct(k.alias("chunk_idx"), T.stripped(F.substr(p, (k - first) * step + 1, F.lit(size))).alias("text"))))

        every = F.flatten(F.transform(F.sequence(F.lit(0), n - 1, group), windows))
        return F.filter(every, lambda x: x["text"] != "")

    def merged(w: Column) -> Column:
        last, before = F.element_at(w, -1), F.get(w, F.size(w) - 2)
        both = F.struct(before["chunk_idx"].alias("chunk_idx"), F.concat(before["text"], F.lit("\n\n"), last["text"]).alias("text"))
        return F.when((F.size(w) > 1) & (F.length(last["text"]) < short), F.concat(F.slice(w, F.lit(1), F.size(w) - 2), F.array(both))).otherwise(w)

    windows = T.let(body, cut)
    rows = pages.filter(F.length(T.stripped("text")) > 0).select("item_key", (T.let(windows, merged) if short else windows).alias("w"))
    return rows.select("item_key", F.explode("w").alias("x")).select("item_key", "x.chunk_idx", "x.text")


def merge_short(chunks: DataFrame, short: int = SHORT) -> DataFrame:
    """A last chunk below `short` characters joins the one before, with a blank line."""
    w = Window.partitionBy("item_key").orderBy("chunk_idx")
    seen = chunks.withColumns({"after": F.lead("text").over(w), "last": F.lead("chunk_idx", 2).over(w).isNull(), "before": F.lag("text").over(w)})
    is_tail = F.col("after").isNull() & F.col("before").isNotNull() & (F.length("text") < short)
    joined = F.when(F.col("last") & F.col("after").isNotNull() & (F.length("after") < short), F.concat("text", F.lit("\n\n"), "after")).otherwise(F.col("text"))
    return seen.filter(~is_tail).select("item_key", "chunk_idx", joined.alias("text"))


def first_word(text: Column) -> Column:
    """The first word, lower-cased, without marks at its edges."""
    return F.lower(F.regexp_replace(F.get(F.split(T.stripped(text), r"\s+"), 0), f"^[{EDGES}]+|[{EDGES}]+$", ""))


def tagged(chunks: DataFrame) -> DataFrame:
    """chunk_id, language, sentence_count, starts_with_conjunction, quality_flag, has_figure_table beside the chunk."""
    t = F.col("text")
    n = F.size(T.sentences(t))
    return chunks.select(
        F.concat_ws(":", "item_key", F.col("chunk_idx").cast("string")).alias("chunk_id"),
        "item_key",
        "chunk_idx",
        "text",
        T.chunk_language(t).alias("language"),
        n.alias("sentence_count"),
        first_word(t).isin(*CONJUNCTIONS).alias("starts_with_conjunction"),
        F.when((F.length(t) < 40) | (n == 0), "incomplete").otherwise("good").alias("quality_flag"),
        t.rlike(CAPTION).alias("has_figure_table"),
    )


def page_offsets(pages: DataFrame) -> DataFrame:
    """item_key, page_num, start, end: where each page lies in the item's joined text; pages are joined by a line feed."""
    w = Window.partitionBy("item_key").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(T.soft_wraps(F.col("text"))) + 1
    start = F.coalesce(F.sum(size).over(w), F.lit(0))
    return pages.select("item_key", "page_num", start.alias("start"), (start + size).alias("end"))


def page_at(positions: DataFrame, offsets: DataFrame) -> DataFrame:
    """positions (item_key, pos) with the page whose range holds pos."""
    return positions.join(offsets, (positions["item_key"] == offsets["item_key"]) & (offsets["start"] <= positions["pos"]) & (positions["pos"] < offsets["end"])).select(positions["*"], "page_num")


HEAD_CHARS = 200


def heading(text: Column) -> Column:
    """struct(level, title) of the heading in a chunk's first HEAD_CHARS characters; null without one.

    Top-level looks are tried in order, then those of subsections. A level is what the numeral's dots say; the title comes
    without numeral and has 3 to 100 characters, three in ten of them letters at least."""
    head = F.substring(text, 1, HEAD_CHARS)

    def found(looks: list[str]) -> Column:
        each = [F.when(head.rlike(p), F.struct(F.regexp_extract(head, p, 1).alias("n"), T.stripped(F.regexp_extract(head, p, 2)).alias("title"))) for p in looks]
        one = F.coalesce(*each)
        dots = F.when(one["n"].rlike(r"^\d+\.\d+"), F.length(one["n"]) - F.length(F.translate(one["n"], ".", "")) + 1).otherwise(1)
        title = one["title"]
        letters = F.regexp_count(title, F.lit(r"\p{L}"))
        return F.when(F.length(title).between(3, 100) & (letters >= 0.3 * F.length(title)), F.struct(F.least(dots, F.lit(3)).alias("level"), title.alias("title")))

    look = lambda n, mark, title: rf"(?m)^\s*({n}){mark}[ \t]*({title})$"
    top = [look(*x) for x in NUMBERED] + [rf"(?m)^\s*()({x})\s*$" for x in BARE]
    return F.coalesce(found(top), found([look(*x) for x in SUBNUMBERED]))


def heading_level(text: Column) -> Column:
    return heading(text)["level"]


def number_alone(text: Column) -> Column:
    """A numeral that is a line of its own in a chunk's first characters; null without one."""
    head = F.substring(text, 1, HEAD_CHARS)
    each = [F.when(head.rlike(f"(?m){p}"), F.regexp_extract(head, f"(?m){p}", 1)) for p in ALONE]
    one = F.coalesce(*each)
    return F.when(F.length(one).between(1, 20), one)


def section_type(heading: Column) -> Column:
    low = F.lower(heading)
    return F.coalesce(*(F.when(low.rlike(words), F.lit(name)) for name, words in SECTION_TYPES.items()), F.lit("unknown"))


def sections(chunks: DataFrame) -> DataFrame:
    """item_key, section_idx, heading, section_type, level, parent_idx, chunk_start_idx, chunk_end_idx.

    A section runs from its heading's chunk to the next heading; chunks before the first heading are an unknown section. In
    an item without headings numbers that stand alone head sections of unknown type."""
    fine = F.coalesce(F.col("quality_flag"), F.lit("good")) != "incomplete"
    by = Window.partitionBy("item_key")
    marked = chunks.select("item_key", "chunk_idx", F.when(fine, heading(F.col("text"))).alias("h"), F.when(fine, number_alone(F.col("text"))).alias("n"))
    bare = F.max(F.col("h").isNotNull()).over(by)
    title = F.when(bare, F.col("h.title")).otherwise(F.col("n"))
    kind = F.when(bare, section_type(F.col("h.title"))).otherwise("unknown")
    marked = marked.select("item_key", "chunk_idx", title.alias("title"), kind.alias("kind"), F.coalesce("h.level", F.lit(1)).alias("level"))
    marked = marked.withColumn("section_idx", F.sum(F.col("title").isNotNull().cast("int")).over(by.orderBy("chunk_idx")))
    first = F.min_by(F.struct("title", "kind", "level"), "chunk_idx")
    grouped = marked.groupBy("item_key", "section_idx").agg(first.alias("f"), F.min("chunk_idx").alias("chunk_start_idx"), F.max("chunk_idx").alias("chunk_end_idx"))
    has = F.col("f.title").isNotNull()
    out = grouped.select("item_key", "section_idx", F.coalesce("f.title", F.lit("")).alias("heading"), F.when(has, F.col("f.kind")).otherwise("unknown").alias("section_type"), "f.level", "chunk_start_idx", "chunk_end_idx")
    before = by.orderBy("section_idx").rowsBetween(Window.unboundedPreceding, -1)
    one, two = (F.max(F.when(F.col("level") <= k, F.col("section_idx"))).over(before) for k in (1, 2))
    parent = F.when(F.col("level") == 2, one).when(F.col("level") == 3, F.greatest(one, two))
    return out.withColumn("parent_idx", parent)


def section_map(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """item_key, chunk_idx, section_idx: each chunk's section, by range."""
    spans = found.select("item_key", "section_idx", "chunk_start_idx", "chunk_end_idx")
    return chunks.join(spans, "item_key").filter(F.col("chunk_idx").between(F.col("chunk_start_idx"), F.col("chunk_end_idx"))).select("item_key", "chunk_idx", "section_idx")


def enriched(text: Column, title: Column, year: Column, keywords: Column, section: Column, title_en: Column | None = None, keywords_en: Column | None = None) -> Column:
    """A line of "[Keywords: …] [Title: … (year)] [Section: …]", with English forms where there are any, then the text."""
    some = lambda c, most: F.substring(F.nullif(F.trim(c), F.lit("")), 1, most)
    dated = F.concat(some(title, 150), F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(""))
    parts = {"Keywords": some(keywords, 200), "Title": dated, "Section": F.when(section != "content", some(section, 120))}
    if title_en is not None:
        parts |= {"Title_EN": some(title_en, 150), "Keywords_EN": some(keywords_en, 200)}
    head = F.concat_ws(" ", *(F.concat(F.lit(f"[{k}: "), v, F.lit("]")) for k, v in parts.items()))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit("\n"), text))


def header_keywords(document: Column) -> Column:
    """The keywords of an enriched text's first line; empty without any."""
    return F.trim(F.regexp_extract(document, r"\[Keywords:\s*([^\n]*?)\](?=\s*\[|\s*(?:\n|$))", 1))


def without_header(document: Column) -> Column:
    """What follows the first line; the whole of a text that has one line only."""
    return F.when(F.instr(document, "\n") > 0, F.substr(document, F.instr(document, "\n") + 1)).otherwise(document)


def bilingual(papers: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """item_key, title_en, keywords_en of the papers (item_key, title, keywords) with a Chinese title; each distinct text is
    given to the model once."""
    mine = papers.filter(T.is_chinese(F.col("title"))).select("item_key", "title", F.when(T.is_chinese(F.col("keywords")), F.col("keywords")).alias("keywords"))
    each = mine.select(F.explode(F.array("title", "keywords")).alias("x")).filter("x is not null").distinct().withColumn("en", models.translated(F.col("x"), model))
    t, k = each.toDF("title", "title_en"), each.toDF("keywords", "keywords_en")
    return mine.join(t, "title", "left").join(k, "keywords", "left").select("item_key", F.coalesce("title_en", F.lit("")).alias("title_en"), F.coalesce("keywords_en", F.lit("")).alias("keywords_en"))


def re_enriched(index: DataFrame, english: DataFrame) -> DataFrame:
    """chunk_id, document of the chunks of an index (chunk_id, item_key, document, title, year, section) that change when
    their papers' English forms (item_key, title_en, keywords_en) enter the header. Keywords come from the old header."""
    rows = index.join(english.filter("title_en <> ''"), "item_key")
    fresh = enriched(without_header(F.col("document")), F.col("title"), F.col("year"), header_keywords(F.col("document")), F.col("section"), F.col("title_en"), F.col("keywords_en"))
    return rows.withColumn("fresh", fresh).filter("fresh <> document").select("chunk_id", F.col("fresh").alias("document"))


def keyword_tags(tags: Column, prefixes: tuple[str, ...] = ("_", "#", "/")) -> Column:
    """Tags of three characters or more without an organising prefix, joined."""
    keep = F.filter(tags, lambda x: (F.length(x) >= 3) & ~F.substring(x, 1, 1).isin(*prefixes))
    return F.array_join(keep, ", ")


# --- the general chunker: order-dependent folds over one item's pages, so a grouped pandas function ---

ENDS, CLAUSES = "。！？；.!?;", "，、：,:"
REFERENCES = re.compile(r"(?mi)^\s*(?:references|bibliography|参考文献)\s*$")
AFTER_REFERENCES = re.compile(r"(?mi)^\s*(?:appendix|acknowledge?ments?|附录|致谢)\b.*$")
TABLE_HEAD = re.compile(r"(?m)^\s*(?:table|表)\s*(\d+)[.:\s].*$", re.IGNORECASE)
FIGURE_HEAD = re.compile(r"(?m)^\s*(?:figure|fig\.|图)\s*(\d+)[.:\s].*$", re.IGNORECASE)
REFS = {"table": re.compile(r"(?:tables?|表)\s*(\d+(?:\s*(?:,|and|&|、|和|-)\s*\d+)*)(?!\s*(?:个|种|项|年|rows|columns))", re.IGNORECASE), "figure": re.compile(r"(?:figures?|figs?\.|图)\s*(\d+(?:\s*(?:,|and|&|、|和|-)\s*\d+)*)(?!\s*(?:个|种|项|年))", re.IGNORECASE)}
LAST_WORDS = re.compile(r"[" + re.escape(ENDS) + r"]")


def split_sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[。！？；])|(?<=[.!?;])\s+", text) if x.strip()]


def best_cut(text: str, most: int) -> int:
    """Where to cut: after a sentence, else a clause, else white space, in the second half of `most`; else at most."""
    for marks in (ENDS, CLAUSES, " \n\t"):
        at = max(text.rfind(m, most // 2, most) for m in marks)
        if at >= 0:
            return at + 1
    return most


def hard_split(text: str, most: int = MOST) -> list[str]:
    out = []
    while len(text) > most:
        at = best_cut(text, most)
        out.append(text[:at].strip())
        text = text[at:].strip()
    return [x for x in [*out, text] if x]


def tail(text: str, window: int = 200) -> str:
    """What follows the last sentence end in the last characters; after a closing one, what follows the last clause mark."""
    end = text[-window:]
    for marks in (ENDS, CLAUSES):
        at = max(end.rstrip()[:-1].rfind(m) if marks is CLAUSES else end.rfind(m) for m in marks)
        if at >= 0 and (rest := end[at + 1 :].strip()):
            return rest
    return ""


def is_prose(line: str) -> bool:
    line = line.strip()
    if not line or sum(c.isdigit() for c in line) >= 0.25 * len(line):
        return False
    cjk = sum("一" <= c <= "鿿" for c in line)
    return (line[-1] in ENDS and len(line) >= 12) or (cjk >= 0.5 * len(line) and len(line) >= 24) or len(line) >= 50


def is_tabular(lines: list[str]) -> bool:
    lines = [x.strip() for x in lines if x.strip()]
    if len(lines) < 3:
        return False
    alike = sum(len(x) <= 25 or sum(c.isdigit() for c in x) >= 0.2 * len(x) for x in lines)
    return alike >= 0.6 * len(lines)


def take_tables(text: str) -> tuple[list[tuple[str, str]], str]:
    """(ref, caption and body) of each table, the longest of a ref; and the text without them."""
    found: dict[str, str] = {}
    spans = []
    for m in TABLE_HEAD.finditer(text):
        lines, blank, at = [], 0, m.end()
        for line in text[m.end() :].splitlines(keepends=True)[1:]:
            blank = blank + 1 if not line.strip() else 0
            if blank >= 2 or is_prose(line) or TABLE_HEAD.match(line) or at - m.start() > 1100:
                break
            lines.append(line)
            at += len(line)
        if is_tabular(lines):
            body = (m[0].strip() + "\n" + "".join(lines)).strip()[:1190]
            if len(body) > len(found.get(m[1], "")):
                found[m[1]] = body
            spans.append((m.start(), at + 1))
    for a, b in reversed(spans):
        text = text[:a] + "\n" + text[b:]
    return sorted(found.items(), key=lambda x: int(x[0])), text


def take_figures(text: str) -> list[tuple[str, str]]:
    found: dict[str, str] = {}
    for m in FIGURE_HEAD.finditer(text):
        if len(m[0].strip()) > len(found.get(m[1], "")):
            found[m[1]] = m[0].strip()
    return sorted(found.items(), key=lambda x: int(x[0]))


def cited(text: str, kind: str, known: set[str]) -> list[str]:
    """Numbers cited after a prefix, of those that exist in the item."""
    out = []
    for m in REFS[kind].finditer(text):
        out += [x for x in re.findall(r"\d+", m[1]) if x in known and x not in out]
    return sorted(out, key=int)


def reference_range(text: str) -> tuple[int, int]:
    """From the first references heading to the next heading that may follow it, or the end; empty without one."""
    m = REFERENCES.search(text)
    if not m:
        return len(text), len(text)
    n = AFTER_REFERENCES.search(text, m.end())
    return m.start(), n.start() if n else len(text)


def pack(text: str, most: int = MOST, least: int = 100) -> list[tuple[int, str, bool]]:
    """(offset, chunk, in references): paragraphs packed up to `most`, long ones by sentences, with the tail of the last chunk before each; chunks break where the references begin and end."""
    first, last = reference_range(text)
    pieces = []
    for m in re.finditer(r"(?:(?!\n\s*\n).)+", text, re.S):
        if m[0].strip():
            parts = [m[0].strip()] if len(m[0]) <= most else split_sentences(m[0])
            pieces += [(m.start(), x, first <= m.start() < last) for x in parts]
    out: list[tuple[int, str, bool]] = []
    at, held, inside = 0, "", False

    def flush() -> None:
        if len(held.strip()) >= least // 2:
            out.append((at, held.strip(), inside))

    for start, x, ref in pieces:
        if held and (ref != inside or len(held) + 2 + len(x) > most):
            before, was = held, inside
            flush()
            keep = tail(before) if ref == was and not ref else ""
            held = keep if len(keep) + 2 + len(x) <= most else ""
            at = start
        at = at if held else start
        held, inside = (held + "\n\n" + x if held else x), ref
    if held:
        flush()
    return out


def chunk_item(pages: list[tuple[int, str]], size: int = SIZE, step: int = STEP, most: int = MOST) -> list[dict]:
    """All chunks of one item, prose first, then tables and figures; see the rules in the functions above."""
    text, bounds = "", []
    for number, x in sorted(pages):
        if x and x.strip():
            x = re.sub(r"([A-Za-z])-\n([a-z])", r"\1\2", x)
            x = re.sub(r"([一-鿿])\n([一-鿿])", r"\1\2", x)
            bounds.append((len(text), number))
            text += x + "\n"
    if not text.strip():
        return []

    def page(at: int) -> int:
        return next((n for start, n in reversed(bounds) if start <= at), bounds[0][1])

    tables, prose = take_tables(text)
    figures = take_figures(prose)
    known = {"table": {r for r, _ in tables}, "figure": {r for r, _ in figures}}
    paragraphs = [x for x in re.split(r"\n\s*\n", prose) if x.strip()]
    if len(paragraphs) <= 2 or not any(len(x) > 50 for x in paragraphs):
        found, start = [], 0
        while start < len(prose):
            x = prose[start : start + size].strip()
            if not x:
                break
            found.append((start, x, False))
            if start + size >= len(prose):
                break
            start += step
    else:
        found = pack(prose, most)
    cut = [(at, y, ref) for at, x, ref in found for y in hard_split(x, most)]
    merged: list[tuple[int, str, bool]] = []
    for i, (at, x, ref) in enumerate(cut):
        if len(x) < SHORT and merged:
            merged[-1] = (merged[-1][0], merged[-1][1] + "\n\n" + x, merged[-1][2])
        elif len(x) < SHORT and i + 1 < len(cut):
            cut[i + 1] = (at, x + "\n\n" + cut[i + 1][1], cut[i + 1][2])
        else:
            merged.append((at, x, ref))
    rows = [{"text": x, "page_start": page(at), "page_end": page(at + max(0, len(x) - 1)), "section": "references" if ref else "content", "kind": "prose", "ref": None} for at, x, ref in merged]
    for kind, items in (("table", tables), ("figure", figures)):
        rows += [{"text": x, "page_start": page(max(0, text.find(x[:40]))), "page_end": page(max(0, text.find(x[:40]))), "section": "content", "kind": kind, "ref": r} for r, x in items]
    for i, row in enumerate(rows):
        prose_row = row["kind"] == "prose"
        row |= {"chunk_idx": i, "table_refs": cited(row["text"], "table", known["table"]) if prose_row else [], "figure_refs": cited(row["text"], "figure", known["figure"]) if prose_row else []}
    return rows


CHUNK_SCHEMA = "item_key string, chunk_idx int, text string, page_start int, page_end int, section string, kind string, ref string, table_refs array<string>, figure_refs array<string>"


def chunked(pages: DataFrame) -> DataFrame:
    """pages (item_key, page_num, text) to chunks, tables and figures. One item's pages are together; an item is one document."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        rows = chunk_item(list(zip(frame["page_num"].tolist(), frame["text"].tolist(), strict=True)))
        out = pd.DataFrame(rows, columns=["chunk_idx", "text", "page_start", "page_end", "section", "kind", "ref", "table_refs", "figure_refs"])
        out.insert(0, "item_key", frame["item_key"].iloc[0])
        return out

    return pages.select("item_key", "page_num", "text").groupBy("item_key").applyInPandas(one, CHUNK_SCHEMA)
