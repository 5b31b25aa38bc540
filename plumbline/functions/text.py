"""Text keys: ten different normal forms, comparison ladders, codes, clauses and names.

All are column expressions but normalize(), whose Unicode compatibility form Spark has no function for: that one is a
vectorised pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and word lists that results depend on.
CJK = r"\x{4E00}-\x{9FFF}"
KNOWN_CONTENT = {
    "服务热线": ("服务热线", "热线", "HOTLINE"),
    "MAC地址": ("MAC", "MAC地址"),
    "禁止强电": ("禁止强电", "LOWVOLTAGE", "LOW VOLTAGE", "禁止接入强电", "POWERLINEISFORBIDDEN"),
    "地暖阀": ("地暖阀",),
    "DC15/24V": ("DC15/24V", "DC15", "DC24"),
    "二维码": ("二维码",),
}
ALIASES = {"禁止强电": ("LOWVOLTAGE", "LOW VOLTAGE"), "MAC地址": ("MAC",), "地暖阀": ("地暖阀",), "服务热线": ("服务热线", "热线"), "二维码": ("二维码",)}
ITEM_SUFFIXES = ("地址", "号码", "编号", "代码", "标识", "内容", "信息", "处")
VIEW_WORDS = (
    ("上盖", "TopCover"), ("面板", "TopCover"), ("顶部", "TopCover"), ("前壳", "TopCover"), ("顶盖", "TopCover"),
    ("下盖", "BottomCover"), ("底壳", "BottomCover"), ("底部", "BottomCover"),
    ("后盖", "Side"), ("后壳", "Side"), ("侧面", "Side"),
    ("接线", "Cable"), ("线材", "Cable"), ("铭牌", "Nameplate"),
)
DECLARATION_ENDS = ("处均使用", "处采用", "处使用", "处均", "均使用", "均为", "均采", "使用激光", "采用激光", "为激光")
CONJUNCTIONS = ("和", "及", "与")
CODE_LABELS = ("子件编码", "子件编号", "物料编码", "物料编号", "材料编码", "零件编码", "零件号", "料号", "编码", "编号", "code")
NAME_LABELS = ("子件名称", "物料名称", "材料名称", "零件名称", "材料信息", "品名", "名称", "name")
HEADER_WORDS = ("子件编码", "子件名称", "子件代号", "编码", "名称", "数量", "单位", "序号", "规格", "型号", "备注", "库号", "物料编码", "物料名称", "物料代号", "单位数量")
SEPARATOR, NAME_BUDGET, ITEM_LENGTH = "｜", 112, 40


def _upper(text: str | None) -> str | None:
    if text is None:
        return None
    flat = (c for c in unicodedata.normalize("NFKC", text) if not c.isspace())
    return "".join(u if len(u := c.upper()) == 1 else c for c in flat)


@F.pandas_udf(StringType())
def _normalize(texts: pd.Series) -> pd.Series:
    return texts.map(_upper)


def normalize(text: Column) -> Column:
    """Compatibility form without white space, upper case character by character; null is empty."""
    return _normalize(F.coalesce(text, F.lit("")))


def loose_key(normal: Column) -> Column:
    """Of a normalize() text: ASCII letters and digits and CJK ideographs."""
    return F.regexp_replace(normal, r"[^A-Z0-9a-z\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]", "")


def ambiguous_key(loose: Column) -> Column:
    """Of a loose_key() text: characters that are read for each other folded to digits."""
    return F.translate(loose, "OILBSZG", "0118526")


def clean(text: Column) -> Column:
    """Lower case, letters and digits of any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", "")


def halfwidth(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space to ASCII."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    return F.translate(text, wide + "　", "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def name_key(text: Column) -> Column:
    """Half width, lower case, ASCII letters and digits only: a name without any has an empty key."""
    return F.regexp_replace(F.lower(halfwidth(F.coalesce(text, F.lit("")))), "[^0-9a-z]", "")


def comparable(text: Column) -> Column:
    """Lower case without white space and common punctuation."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\-_.,:;：；，。、()（）\[\]【】/\\|'\"]", "")


def core(text: Column) -> Column:
    """Lower case, ASCII letters and digits and CJK ideographs."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), rf"[^0-9a-z{CJK}]", "")


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def etl_key(text: Column) -> Column:
    """Upper case without spaces, underscores and hyphens."""
    return F.translate(F.upper(text), " _-", "")


def compare(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """How two texts agree, from them and their normalize() forms: Exact, Normalized, Ambiguous or None."""
    ra, rb, la, lb = F.trim(a), F.trim(b), loose_key(na), loose_key(nb)
    aa, ab = ambiguous_key(la), ambiguous_key(lb)
    return (
        F.when(a.isNull() | b.isNull() | (ra == "") | (rb == ""), "None")
        .when(ra == rb, "Exact")
        .when((na == "") | (nb == ""), "None")
        .when((na == nb) | ((la != "") & (la == lb)), "Normalized")
        .when((aa != "") & (aa == ab), "Ambiguous")
        .otherwise("None")
    )


def contains(haystack: Column, needle: Column, nh: Column, nn: Column) -> Column:
    """How one text contains another, from them and their normalize() forms; nothing contains an empty text."""
    rh, rn, lh, ln = F.trim(haystack), F.trim(needle), loose_key(nh), loose_key(nn)
    ah, an = ambiguous_key(lh), ambiguous_key(ln)
    return (
        F.when(haystack.isNull() | needle.isNull() | (rh == "") | (rn == ""), "None")
        .when(rh.contains(rn), "Exact")
        .when(((nn != "") & nh.contains(nn)) | ((ln != "") & lh.contains(ln)), "Normalized")
        .when((an != "") & ah.contains(an), "Ambiguous")
        .otherwise("None")
    )


def placeholders(text: Column) -> Column:
    """Whether an unreadable character's stand-in occurs twice or more."""
    return F.length(text) - F.length(F.replace(text, F.lit("口"), F.lit(""))) >= 2


def clause_items(clause: Column) -> Column:
    """The numbered items of a clause, numbers first; the whole clause if it has none."""
    marked = F.regexp_replace(clause, r"(?:^|[：:。，,;；.])\s*(?=[0-9]{1,2}\s*[、.．])", "\u0001")
    parts = F.split(marked, "\u0001")
    items = F.filter(F.slice(parts, 2, F.size(parts)), lambda p: p != "")
    return F.when(F.size(parts) > 1, items).otherwise(F.array(clause))


def strip_clause_number(item: Column) -> Column:
    return F.trim(F.regexp_replace(item, r"^\s*[0-9]+\s*[、.,，]", ""))


def declared(sentence: Column) -> Column:
    """What a sentence declares: the part before its earliest end marker; null without a marker."""
    places = F.filter(F.array(*[F.instr(sentence, m) for m in DECLARATION_ENDS]), lambda p: p > 0)
    return F.when(F.size(places) > 0, F.substring(sentence, F.lit(1), F.array_min(places) - 1))


def split_items(text: Column) -> Column:
    """Items between list commas, cut once more at the first conjunction; distinct, two characters at least."""

    def cut(part: Column) -> Column:
        places = F.filter(F.array(*[F.instr(part, c) for c in CONJUNCTIONS]), lambda p: (p > 1) & (p < F.length(part)))
        at = F.array_min(places)
        return F.when(F.size(places) > 0, F.array(F.trim(F.substring(part, F.lit(1), at - 1)), F.trim(F.substring(part, at + 1, F.length(part))))).otherwise(F.array(part))

    parts = F.transform(F.split(text, "[、,，]"), F.trim)
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, cut)), lambda i: F.length(i) >= 2))


def _literals(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.expr("CAST(array() AS array<string>)")


def match_keys(item: Column) -> Column:
    """Texts an item may appear as: itself, without a suffix, its aliases and known forms."""
    none = _literals(())
    cut = [F.when((F.length(item) > len(s)) & item.endswith(s), F.array(F.substring(item, F.lit(1), F.length(item) - len(s)))).otherwise(none) for s in ITEM_SUFFIXES]
    forms = [
        F.coalesce(*[F.when(item == k, _literals(v)) for k, v in words.items()], none) for words in (ALIASES, KNOWN_CONTENT)
    ]
    return F.array_distinct(F.filter(F.concat(F.array(item), *cut, *forms), lambda k: F.length(k) >= 2))


def model_codes(text: Column) -> Column:
    """Hyphenated model codes, upper case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Z0-9])[A-Z]{2,}(?:-[A-Z0-9]{2,})+(?![A-Z0-9])"), F.lit(0)), F.upper)


def item_code(text: Column) -> Column:
    """The first ten digits that stand alone, else those right before six to twelve more; empty without."""
    alone = F.regexp_extract(text, r"(?<![0-9])([0-9]{10})(?![0-9])", 1)
    tight = F.regexp_extract(text, r"(?<![0-9])([0-9]{10})(?=[0-9]{6,12}(?![0-9]))", 1)
    return F.coalesce(F.when(alone != "", alone).otherwise(tight), F.lit(""))


def strip_label(text: Column, labels: tuple[str, ...]) -> Column:
    """What follows the first of the labels (in their order) that occurs, without separators."""
    value = F.coalesce(*[F.when(text.contains(w), F.substring(text, F.instr(text, w) + len(w), F.length(text))) for w in labels], text)
    return F.trim(F.regexp_replace(F.trim(value), "^[ :：=·.、|　]+", ""))


def clean_info(text: Column) -> Column:
    """A material's name without codes, labels and bars; empty for what is a number, a date or a handler's field."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<![0-9])[0-9]{10}[0-9]{6,12}(?![0-9])", " ")
    t = F.regexp_replace(t, r"(?<![0-9])[0-9]{10}(?![0-9])", " ")
    for word in CODE_LABELS + NAME_LABELS:
        t = F.replace(t, F.lit(word), F.lit(" "))
    t = F.regexp_replace(F.regexp_replace(t, r"[|丨│┃\t]+", " "), r"\s{2,}", " ")
    t = F.regexp_replace(t, "^[ :：=·、,，.。|　]+|[ :：=·、,，.。|　]+$", "")
    field = t.rlike(r"^[0-9\s.\-/]+$") | t.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}") | t.rlike(r"^(经手人|操作人|仓管员|记录员)[：:]\s*\S+\s*$")
    return F.when(field, F.lit("")).otherwise(F.trim(t))


def strip_designator(info: Column) -> Column:
    """Without six to twelve digits and white space at the start."""
    return F.trim(F.regexp_replace(F.trim(info), r"^[0-9]{6,12}(?=[\s　])", ""))


def meaningful_info(info: Column) -> Column:
    """At least two characters with a letter or ideograph, and no header word."""
    return (F.length(info) >= 2) & ~info.isin(*HEADER_WORDS) & ~info.rlike(r"^[0-9\s.\-/]+$") & info.rlike(rf"[{CJK}A-Za-z]")


def view_word(text: Column) -> Column:
    """The first view word, in the list's order, that occurs; null without."""
    return F.coalesce(*[F.when(text.contains(w), F.lit(w)) for w, _ in VIEW_WORDS])


def view_of(word: Column) -> Column:
    return F.coalesce(*[F.when(word == w, F.lit(v)) for w, v in VIEW_WORDS], F.lit("Unspecified"))


def code_hint(decoded: Column, expected: Column) -> Column:
    """What a decoded code says about an expected one; informational."""
    return F.when(F.coalesce(expected, F.lit("")) == "", "").when(F.coalesce(decoded, F.lit("")) == "", "undecoded").when(F.lower(decoded) == F.lower(expected), "same").otherwise("different")


def clip(text: Column, n: int = ITEM_LENGTH) -> Column:
    """At most n characters, the last an ellipsis if any are cut."""
    t = F.trim(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def build_name(texts: Column) -> Column:
    """Texts joined in order until the budget is spent; blank ones are left out."""

    def add(state: Column, raw: Column) -> Column:
        t = clip(raw)
        grown = F.length(state["name"]) + F.length(t) + F.when(state["name"] == "", 0).otherwise(1)
        full = state["full"] | (grown > NAME_BUDGET)
        joined = F.when(state["name"] == "", t).otherwise(F.concat(state["name"], F.lit(SEPARATOR), t))
        return F.when((t == "") | state["full"], state).otherwise(F.struct(F.when(full, state["name"]).otherwise(joined).alias("name"), full.alias("full")))

    start = F.struct(F.lit("").alias("name"), F.lit(False).alias("full"))
    return F.aggregate(F.filter(texts, lambda t: t.isNotNull()), start, add)["name"]
