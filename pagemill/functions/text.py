"""Text rules as column expressions.  White space and letters are matched as Unicode classes that Java and RE2 read alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.stats import let

SPACE = r"[\s\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\p{Z}]"
# Patterns of numbers and of repeated, symbol-only and page-number texts.
LIKE_NUMBER = r"^[\p{Nd}.,%+\-/~():：·¥$€]+$"

STREAK = r"([\x{4e00}-\x{9fff}A-Za-z])\1{2,}"
SYMBOLS_ONLY = r"^[-_—=+*/\\|.·,:;!?()\[\]{}<>]+$"
PAGE_MARK = r"^(第?\p{Nd}+页|\p{Nd}+/\p{Nd}+)$"

# Menu labels of slide editors, footer terms and reason labels.
STRONG_TERMS = ("智能图形", "另存为", "幻灯片", "放映", "批注", "缩放")
WEAK_TERMS = (
    "填充", "查找", "替换", "搜索", "菜单", "工具", "视图", "帮助",
    "开始", "插入", "设计", "切换", "动画", "审阅",
    "文件", "编辑", "格式", "共享", "登录", "选择", "打印", "导出",
    "文本框", "形状", "轮廓", "对齐", "旋转",
    "艺术字", "绘图", "演示工具", "演示",
)
FOOTER_TERMS = ("版权", "保留", "所有权利", "confidential", "版权所有", "有限公司", "咨询")
REASON_LABELS = {"toolbar": "编辑器/导航栏按钮", "symbol": "纯符号噪音", "empty": "空白内容", "page_number": "页号", "header": "页眉", "footer": "页脚/版权信息"}
MATH_SIGNS = "+-=*/^_{}[]()<>|∑∫√≠≈≤≥±×÷παβγθ"
SUMMARY_LIMIT, SUMMARY_TOLERANCE = 30, 0.30


def compact(text: Column) -> Column:
    return F.regexp_replace(text, SPACE + "+", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(compact(text) == "", F.lit(True))


def count_terms(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, (text.contains(t).cast("int") for t in terms))


def noise_kind(text: Column, in_margin: Column | bool = True) -> Column:
    """empty, toolbar, symbol, page_number, or null for content."""
    margin = F.lit(in_margin) if isinstance(in_margin, bool) else in_margin
    return let(compact(F.coalesce(text, F.lit(""))), lambda c: let(count_terms(c, WEAK_TERMS), lambda weak: noise_kind_of(c, weak, margin)))


def noise_kind_of(c: Column, weak: Column, margin: Column) -> Column:
    """The same from the compacted text and its number of weak terms."""
    streak = c.rlike(STREAK) & ~c.rlike(LIKE_NUMBER)
    return (
        F.when(c == "", "empty")
        .when(c.rlike("|".join(STRONG_TERMS)) | (weak >= 2) | (margin & (F.length(c) <= 8) & (weak >= 1)) | (margin & streak), "toolbar")
        .when(c.rlike(SYMBOLS_ONLY), "symbol")
        .when(c.rlike(PAGE_MARK), "page_number")
    )


def is_margin_noise(text: Column) -> Column:
    """Short or boilerplate text of a page margin; number-like tokens never are."""
    return is_margin_noise_of(compact(text))


def is_margin_noise_of(c: Column) -> Column:
    """The same from the compacted text, as the next two."""
    return ~c.rlike(LIKE_NUMBER) & (F.lower(c).rlike("|".join(FOOTER_TERMS)) | (F.length(c) <= 6))


def explicit_page_number(text: Column) -> Column:
    """N/M from anywhere in the text, or N of 第N页; null if neither."""
    return explicit_page_number_of(compact(text))


def explicit_page_number_of(c: Column) -> Column:
    pair = r"(\p{Nd}+)/(\p{Nd}+)"
    page = r"^第?(\p{Nd}+)页$"
    return F.when(c.rlike(pair), F.regexp_extract(c, pair, 0)).when(c.rlike(page), F.regexp_extract(c, page, 1))


def bare_page_number(text: Column) -> Column:
    return bare_page_number_of(compact(text))


def bare_page_number_of(c: Column) -> Column:
    return F.when(c.rlike(r"^\p{Nd}{1,4}$"), c)


def clean_title(title: Column) -> Column:
    """Takes away doubled ideographs, dash runs, and blanks beside full-width brackets."""
    t = F.regexp_replace(title, r"([\x{4e00}-\x{9fff}])([\s\p{Z}]+)\1(?=[\x{4e00}-\x{9fff}—\-])", "$1$2")
    t = F.regexp_replace(t, r"[一—\-]{2,}", "一")
    t = F.regexp_replace(t, r"[\s\p{Z}]+([（）【】《》])", "$1")
    t = F.regexp_replace(t, r"([（【《])[\s\p{Z}]+", "$1")
    return stripped(F.regexp_replace(t, r"[\s\p{Z}]{2,}", " "))


def leading_sentence(text: Column) -> Column:
    """The first sentence without list marks and double quotes; the whole text if it begins with a sentence end."""
    t = F.replace(stripped(F.regexp_replace(text, r"^[>#*\-–—•·\s\p{Z}]+", "")), F.lit('"'), F.lit("'"))
    first = stripped(F.regexp_extract(t, r"^[^。！？；;.!?]*", 0))
    return F.when(first == "", t).otherwise(first)


def summary_mode(sentence: Column, limit: int = SUMMARY_LIMIT, tolerance: float = SUMMARY_TOLERANCE) -> Column:
    n = F.length(sentence)
    return F.when(n <= limit, "complete").when((n - limit) / F.lit(limit) < tolerance, "tolerated").otherwise("condensed")


def condensed(sentence: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """As many leading clauses as fit into limit; else the longest part of the first `limit` characters that ends before a separator, if at least half as long."""
    clauses = F.regexp_extract_all(sentence, F.lit(r"[^，、：,;]*[，、：,;]|[^，、：,;]+$"), F.lit(0))
    folded = F.aggregate(
        clauses,
        F.struct(F.lit("").alias("held"), F.lit(True).alias("open")),
        lambda s, c: F.when(
            s["open"] & (F.length(F.concat(s["held"], F.regexp_replace(c, "[，、：,;]$", ""))) <= limit),
            F.struct(F.concat(s["held"], c).alias("held"), F.lit(True).alias("open")),
        ).otherwise(F.struct(s["held"].alias("held"), F.lit(False).alias("open"))),
    )["held"]
    held = stripped(F.regexp_replace(folded, "[，、：,; ]+$", ""))
    window = F.substring(sentence, 1, limit)
    before = F.regexp_extract(window, "^(.*)[，、：, ]", 1)
    hard = F.when(F.length(before) >= limit // 2, before).otherwise(window)
    return F.when(held != "", held).otherwise(stripped(hard))


def summary_title(text: Column) -> Column:
    s = clean_title(leading_sentence(text))
    return F.when(summary_mode(s) == "condensed", condensed(s)).otherwise(s)


def text_key(text: Column) -> Column:
    """Letters and digits in lower case: what two texts have in common that read the same."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", ""))


def same_text(a: Column, b: Column) -> Column:
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (text_key(a) == text_key(b))


def escape_cell(text: Column) -> Column:
    return stripped(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def numeric_tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")))


def line_key(line: Column) -> Column:
    return F.lower(F.regexp_replace(line, r"[|\-\s\p{Z}]", ""))


def without_fences(md: Column) -> Column:
    return stripped(F.replace(F.replace(F.coalesce(md, F.lit("")), F.lit("```markdown"), F.lit("")), F.lit("```"), F.lit("")))


def first_table_html(text: Column) -> Column:
    """The first <table ...</table>, or null."""
    found = F.regexp_extract(text, r"(?is)<table.*?</table>", 0)
    return F.when(found != "", found)


def cell_texts(html: Column) -> Column:
    """Compacted non-empty texts of <td> cells."""
    inner = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1))
    return F.filter(F.transform(inner, lambda x: compact(F.regexp_replace(x, "<[^>]+>", ""))), lambda x: x != "")


# Named character references of HTML that tables use.
NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&amp;", "&"))


def unescape_html(text: Column) -> Column:
    """Numbered character references, and the named ones of NAMED, as the characters they stand for."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))

    def replaced(t: Column, code: Column) -> Column:
        hex_code = F.when(F.lower(F.substring(code, 1, 1)) == "x", F.substring(code, 2, 6)).otherwise(F.conv(code, 10, 16))
        sign = F.decode(F.unhex(F.lpad(hex_code, 8, "0")), "UTF-32")
        valid = F.conv(hex_code, 16, 10).cast("int").between(1, 0xD7FF) | F.conv(hex_code, 16, 10).cast("int").between(0xE000, 0x10FFFF)
        return F.when(valid, F.replace(t, F.concat(F.lit("&#"), code, F.lit(";")), F.when(valid, sign))).otherwise(t)

    out = F.aggregate(found, text, replaced)
    for name, sign in NAMED:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def html_rows(html: Column, tidy: bool = True) -> Column:
    """array<array<string>>: texts of the <td> and <th> of each closed <tr>; tidy: white space collapsed, rows without text dropped."""
    rows = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr\s*>"), F.lit(1))

    def cells(row: Column) -> Column:
        inner = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]\s*>"), F.lit(1))
        texts = F.transform(inner, lambda x: unescape_html(F.regexp_replace(x, r"<!--(?s:.*?)-->|</?[A-Za-z][^>]*>", "")))
        return F.transform(texts, (lambda x: stripped(F.regexp_replace(x, SPACE + "+", " "))) if tidy else stripped)

    out = F.transform(rows, cells)
    return F.filter(out, lambda r: F.exists(r, lambda c: c != "")) if tidy else out


def has_ocr_errors(text: Column) -> Column:
    """Both signs of a pair that recognisers mix up, or any sign beyond ASCII."""
    pairs = (("0", "O"), ("1", "l"), ("5", "S"), ("8", "B"))
    return reduce(Column.__or__, (text.contains(a) & text.contains(b) for a, b in pairs)) | text.rlike(r"[^\x00-\x7F]")


def has_math(text: Column) -> Column:
    return F.length(F.translate(text, MATH_SIGNS, "")) < F.length(text)


def sanitize_filename(name: Column) -> Column:
    safe = F.regexp_replace(name, r"[^\p{L}\p{N} \-_.]", "_")
    return F.regexp_replace(F.translate(safe, " ", "-"), "-{2,}", "-")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def stem(path: Column) -> Column:
    """The file name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def note_file_name(path: Column, run_date: Column) -> Column:
    return F.concat(F.date_format(run_date, "yyyy-MM-dd"), F.lit("_"), sanitize_filename(stem(path)), F.lit(".md"))


def front_matter(title: Column, source: Column, confidence: Column, has_tables: Column, run_date: Column, page_number: Column) -> Column:
    tags = F.when(has_tables, F.lit('"ocr/pending", "ocr/table"')).otherwise(F.lit('"ocr/pending"'))
    page = F.when(F.coalesce(page_number, F.lit("")) != "", F.concat(F.lit("\npage: "), page_number)).otherwise(F.lit(""))
    return F.concat(
        F.lit('---\ntitle: "'), title, F.lit('"\ndate: '), F.date_format(run_date, "yyyy-MM-dd"), page,
        F.lit("\ntags: ["), tags, F.lit(']\nstatus: pending\nsource: "[[00-RAW/'), base_name(source),
        F.lit(']]"\nocr_confidence: '), F.format_string("%.2f", confidence.cast("double")), F.lit("\n---"),
    )


# The notes for reviewers.
REVIEW_HEAD = "> [!todo] 待确认事项（需人工核对）\n> - 本页未检测到明显的加大/加粗标题；标题 `"
REVIEW_DETAIL = {
    "condensed": "系由正文首段语义压缩生成（首句超出字数上限 30% 以上，已总结为短语，可能损失部分语义）。请人工确认标题是否准确或改写。",
    "tolerated": "系取正文首句完整生成（略超字数上限但在 30% 以内，为保留语义完整性未截断）。请人工确认标题是否准确或改写。",
    "complete": "系由正文首段自动摘要生成（已限长）。原图多为纯文本稀疏页，请人工确认标题是否准确或改写。",
}
FILTERED_HEAD = "<!-- Filtered non-content (nav bars / headers / footers) - review before archiving -->\n> [!note] 已过滤无关内容，请人工审核后归档。每条已标注过滤原因（页号仅供连续归档参考）。"
OTHER_REASON = "其他无关内容"
LINKS_HEAD = "<!-- Link Candidates (for review) -->\n"


def review_note(title: Column, title_source: Column, mode: Column) -> Column:
    detail = F.when(mode == "condensed", REVIEW_DETAIL["condensed"]).when(mode == "tolerated", REVIEW_DETAIL["tolerated"]).otherwise(REVIEW_DETAIL["complete"])
    return F.when(title_source == "summary", F.concat(F.lit(REVIEW_HEAD), title, F.lit("` "), detail)).otherwise(F.lit(""))


def reason_label(reason: Column) -> Column:
    out = F.lit(OTHER_REASON)
    for k, v in REASON_LABELS.items():
        out = F.when(reason == k, v).otherwise(out)
    return out


def stable_lines(md: Column) -> Column:
    """Lines but those that begin with "date:"."""
    return F.filter(F.split(md, "\r\n|\n|\r"), lambda x: ~x.startswith("date:"))


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences; of an empty term, one between any two signs and at both ends."""
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return F.when(F.length(term) == 0, F.length(text) + 1).otherwise(n).cast("long")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def ngrams(words: Column, longest: int = 5, norms: Column | None = None) -> Column:
    """array<struct<n, pos, text>>, shorter ones first, then by place; with norms, other forms of the words, also norm."""
    joined = lambda a, i, n: F.array_join(F.slice(a, i + 1, n), " ")

    def of(n: int) -> Column:
        at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        more = lambda i: [] if norms is None else [joined(norms, i, n).alias("norm")]
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), i.alias("pos"), joined(words, i, n).alias("text"), *more(i)))

    return F.concat(*(of(n) for n in range(1, longest + 1)))


def accepts_path(path: Column, extensions: tuple[str, ...], skip: tuple[str, ...] = ()) -> Column:
    """Known suffix, any case, and no skip pattern: **/x is x anywhere, *x an ending, x anywhere; with * inside, a glob of the file name."""
    ok = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*extensions)
    for pattern in skip:
        ok = ok & ~matches_pattern(path, pattern)
    return ok


def matches_pattern(path: Column, pattern: str) -> Column:
    rest = pattern.removeprefix("**/")
    if "*" in rest.removeprefix("*" if rest is pattern else ""):
        glob = "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in rest)
        return base_name(path).rlike(f"^{glob}$")
    if rest is not pattern:
        return path.contains(rest)
    return path.endswith(pattern[1:]) if pattern.startswith("*") else path.contains(pattern)
