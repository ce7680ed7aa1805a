"""Line-wise cleaning of extracted page text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: white space, digits and brackets as journals print them; labels in brackets or before a colon
S, D, OPEN, CLOSE, COLON = r"[\s\x{3000}\x{a0}]", "[0-9０-９]", "[〔\\[]", "[〕\\]]", "[:：]"
DATED = "收稿|修回|修订|投稿|录用|收到"
ROLES = "Conceptualization|Methodology|Software|Validation|Formal analysis|Investigation|Resources|Data [Cc]uration|Writing .*|Visualization|Supervision|Project administration|Funding acquisition"
DECLARED = "The authors declare that they have no known|interests or personal relationships that could have appeared|Declaration of [Cc]ompeting [Ii]nterest"
THESIS = "学生姓名|指导教师|专业学位类别|研究方向|答辩委员会主席|授位时间|培养单位"


def spaced(word: str) -> str:
    """A line of a word whose letters stand apart."""
    return f"^{f'{S}+'.join(word)}{S}*$"


def boxed(words: str) -> str:
    """A label in brackets."""
    return f"{OPEN}{S}*(?:{words}){S}*{CLOSE}"


#: What a line that goes is about, and how such lines look; the first class that a line belongs to names it.
CLASSES = {
    "heading": (
        spaced("ARTICLEINFO"),
        spaced("ABSTRACT"),
        f"^(?i:keywords){COLON}?{S}*$",
        f"^Key{S}+[Ww]ords{COLON}?{S}*$",
        rf"^(?i:{boxed(f'摘{S}*要|关键{S}*词|abstract?|keywords?|key{S}*words')}){S}*$",
    ),
    "statement": (f"^(?:{DECLARED})", rf"^(?:{ROLES})\.{S}"),
    "dates": (
        f"^(?i:received|accepted|published|revised)(?:{S}|:).*{D}{{4}}",
        boxed(f"(?:{DATED})日期"),
        f"^(?:{DATED})日期{COLON}.*{D}{{4}}",
        f"(?:收稿|修回|修订|录用)日期{COLON}{S}*{D}{{4}}[-—]{D}{{2}}[-—]{D}{{2}}",
        f"^(?:{D}{{4}}{S}*年{S}*{D}{{1,2}}{S}*月|[A-Z][a-z]{{2,8}}[．.]{S}*{D}{{4}}|[A-Z][a-z]{{2,8}},{S}*{D}{{4}}){S}*$",
    ),
    "issue": (
        f"第{S}*{D}+{S}*卷{S}*第?{S}*{D}+{S}*期",
        rf"(?i:vol)(?:{S}|[.．，,])+{D}+(?:{S}|[,.．])+(?i:no)(?:{S}|[.．])+{D}+",
        f"总第{S}*{D}+{S}*期",
        f"^[A-Z][a-z]+ {D}{{4}}, {D}{{1,2}}, (?:x{S}*)?{D}+(?:{S}+of{S}+{D}+)?{S}*$",
    ),
    "identifier": (
        boxed("文章编号"),
        boxed("中图分类号"),
        f"{boxed('文献标识[码志]')}{COLON}?{S}*[A-Za-z]",
        f"文献标识[码志]{COLON}{S}*[A-Za-z]",
        rf"{boxed('ＤＯＩ')}{S}*１０\.{D}{{1,5}}/[^\s\x{{3000}}\x{{a0}}]{{4,80}}{S}*$",
        rf"^(?i:doi){COLON}{S}*10\.",
        f"^(?i:issn|isbn){COLON}{S}*{D}",
    ),
    "funding": (
        f"{OPEN}?{S}*(?:基金项目|基金资助){S}*[:：〕\\]](?:{S}*[^\\s\\x{{3000}}\\x{{a0}}])",
        "国家自然科学基金",
        rf"^{S}*\[?{S}*(?i:foundation){S}*{COLON}{S}*(?i:no)\.",
    ),
    "people": (
        boxed("作者简介"),
        f"^(?:第一作者简介|作者简介|通讯作者|通信作者){S}*{COLON}.*{D}{{4}}{S}*[—-]",
        rf"^(?:第一作者简介|作者简介){S}*{COLON}.*\({D}{{4}}[-—]{S}*\)",
        rf"^\*{S}*(?:通讯|通信)作者{COLON}.*{D}{{4}}",
        f"责任编辑(?:{COLON}|{S})",
    ),
    "citation": (boxed("引用格式|引文格式"), f"^引用格式{COLON}"),
    "thesis": (f"^(?:{THESIS}){COLON}", f"(?:硕士|博士|专业)学位论文{S}*$", "^（专业学位）$"),
    "page": (
        f"^{D}{{1,2}}{S}+of{S}+{D}{{1,2}}{S}*$",
        f"[（(]{S}*(?:上接|下转|续接){S}*第{S}*{D}+{S}*页{S}*[）)]",
        f"^[０-９]{{1,3}}{S}*$",
        f"^{D}{{1,6}}{S}*[-—]{S}*{D}{{1,6}}{S}*页",
        f"^·{S}*{D}{{1,4}}{S}*·{S}*$",
    ),
    "rights": (
        f"^©{S}*{D}{{4}}",
        rf"^(?i:all rights reserved)\.?{S}*$",
        f"^(?i:published (?:by|online))(?:{S}|:)",
        f"^(?i:downloaded (?:from|by))(?:{S}|:)",
    ),
    "link": (rf"^https?://\S+\.\S+{S}*$", rf"^(?i:e[- ]?mail){COLON}{S}*\S+@\S+{S}*$"),
    "empty": (f"{OPEN}{S}*{CLOSE}",),
}
PATTERNS = {name: "|".join(f"(?:{p})" for p in looks) for name, looks in CLASSES.items()}
#: Near such a line, among the last three that were kept, a line of 1 to 4 digits is a page number.
NUMBERED_BESIDE = f"(?i)第{S}*{D}+{S}*卷|vol\\.{D}+|收稿日期|基金项目|作者简介|article info|abstract|keywords|downloaded|published"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
#: Kinds of repeated lines, for noise reports.
NOISE_KINDS = (("page_number", r"^\W*\d{1,4}\W*$"), ("url", r"(?i)https?://|www\."), ("doi", r"(?i)\b10\.\d{4,9}/"), ("email", r"\S+@\S+\.\w+"), ("copyright", r"(?i)©|copyright|all rights reserved"), ("date", r"(?:19|20)\d{2}"))


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, f"^{S}+|{S}+$", "")


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the text's end begins no further line, and an empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END))


def category(line: Column) -> Column:
    """The class of a line that goes; null for blank lines and lines to keep."""
    s = stripped(line)
    return F.when(s != "", F.coalesce(*(F.when(s.rlike(p), F.lit(c)) for c, p in PATTERNS.items())))


def lines(pages: DataFrame) -> DataFrame:
    """item_key, line_no, line, category."""
    return pages.select("item_key", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line")).withColumn("category", category(F.col("line")))


def fates(rows: Column) -> Column:
    """A letter for each line: r matches a class, d is a page number, c a number to keep, n a line that makes numbers beside
    it page numbers, k any other.

    A number goes if one of the three lines kept before it is an n. Numbers that went don't count among the three, nor do
    they end the reach of an n; a number that stays is beyond that reach already. So an n reaches over the next two k."""

    def letter(line: Column) -> Column:
        s = stripped(line)
        gone = reduce(lambda a, b: a | b, (s.rlike(p) for p in PATTERNS.values()))
        return F.when((s != "") & gone, "r").when(s.rlike(f"^{D}{{1,4}}$"), "c").when(s.rlike(NUMBERED_BESIDE), "n").otherwise("k")

    def reached(part: Column) -> Column:
        head = F.regexp_extract(part, "^n[rc]*(?:k[rc]*){0,2}", 0)
        return F.concat(F.translate(head, "c", "d"), F.substr(part, F.length(head) + 1))

    flags = F.array_join(F.transform(rows, letter), "")
    return F.split(F.array_join(F.transform(F.split(flags, "(?=n)"), reached), ""), "")


def cleaned(text: Column) -> Column:
    """The text without lines of a class and page numbers; three line feeds or more become two."""
    rows = split_lines(text)
    fate = F.zip_with(rows, fates(rows), lambda line, f: F.struct(line.alias("line"), f.alias("f")))
    kept = F.transform(F.filter(fate, lambda x: ~x["f"].isin("r", "d")), lambda x: x["line"])
    return F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n")


def report(pages: DataFrame) -> DataFrame:
    """category, n_lines and n_items over all items."""
    return lines(pages).filter("category is not null").groupBy("category").agg(F.count("*").alias("n_lines"), F.countDistinct("item_key").alias("n_items"))


def summary(pages: DataFrame) -> DataFrame:
    """item_key, lines in, lines removed, page numbers among them counted."""
    fate = pages.select("item_key", split_lines(F.col("text")).alias("rows")).select("item_key", F.size("rows").cast("long").alias("lines_in"), fates(F.col("rows")).alias("f"))
    gone = F.size(F.filter("f", lambda x: x.isin("r", "d"))).cast("long")
    return fate.groupBy("item_key").agg(F.sum("lines_in").alias("lines_in"), F.sum(gone).alias("lines_removed"))


def samples(pages: DataFrame, each: int = 10) -> DataFrame:
    """category, line: the first lines removed of each class, cut to 80 characters."""
    found = lines(pages).filter("category is not null")
    place = F.row_number().over(Window.partitionBy("category").orderBy("item_key", "line_no"))
    line = stripped(F.col("line"))
    return found.withColumn("n", place).filter(F.col("n") <= each).select("category", F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 80), F.lit("..."))).otherwise(line).alias("line"))


def noise_patterns(chunks: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """Lines of 5 to 150 characters in an item's first or last two chunks that `least` items share: line, n_items, kind."""
    up = Window.partitionBy("item_key").orderBy("chunk_idx")
    down = Window.partitionBy("item_key").orderBy(F.col("chunk_idx").desc())
    ends = chunks.withColumns({"a": F.row_number().over(up), "b": F.row_number().over(down)}).filter("a <= 2 or b <= 2")
    found = ends.select("item_key", F.explode(F.split("text", "\n")).alias("raw")).select("item_key", F.trim("raw").alias("line")).filter(F.length("line").between(5, 150))
    kind = reduce(lambda out, k: F.when(F.col("line").rlike(k[1]), k[0]).otherwise(out), reversed(NOISE_KINDS), F.lit("other"))
    shared = found.groupBy("line").agg(F.countDistinct("item_key").alias("n_items")).filter(F.col("n_items") >= least)
    return shared.withColumn("kind", kind).orderBy(F.desc("n_items"), "line").limit(most)
