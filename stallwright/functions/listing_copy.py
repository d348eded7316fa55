"""Expressions on listing copy: normal forms, facts in titles, sections, repair.

All but nfkc() stay in the JVM; nfkc() is the one form that Spark has no function for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

#: Size labels, in the order they are reported (fixed values).
SIZES = ("SS", "S", "M", "L", "XL")
#: Words that are no title tokens (fixed values).
TITLE_STOP = ("新品", "おしゃれ", "人気", "おすすめ", "送料無料", "高級")
#: Keyword families of text seen in images (fixed values).
IMAGE_WORDS = {
    "dimension": "(cm|mm|幅|奥行|高さ|サイズ|寸法|直径|長さ|厚さ|重さ|重量)",
    "lifestyle": "(使用|暮らし|リビング|室内|屋外|旅行|収納|介護|子供|キッズ|シーン|イメージ)",
    "detail": "(素材|材質|pu|レザー|スチール|木製|キャスター|ロック|調整|耐荷重|防錆|防水|仕様|構造)",
    "claim": "(保証|防水|防錆|耐荷重|uv|紫外線|tsa|安全|高品質|最適|おすすめ|人気)",
}
#: Segments that narrow a search scope (fixed values).
SEGMENTS = ("(?:1|2|3|一|二|三)人掛け", "(?:シングル|セミダブル|ダブル|クイーン|キング)", "(?:電動|手動|コンセント式|充電式|コードレス)", "(?:折りたたみ|大型|小型|業務用|家庭用)", "(?:ファブリック|本革|合皮|スチール|木製)")
#: Numbers with a unit that have to stand in the evidence (fixed values).
MEASURES = "\\d+(?:\\.\\d+)?\\s?(?:cm|mm|kg|g|l|ml|L|W|V|kW|個|枚|台|色|種類|バリエーション|段階|年|ヶ月|日|泊|畳|キロ|センチ|リットル)"
#: Claims that no copy may make, and facts that need evidence (fixed values).
PROHIBITED = ("no.1", "ナンバーワン", "最安", "絶対", "完全防水", "医療", "治療", "永久保証")
HARD_FACTS = (
    "pse", "日本仕様", "日本企画", "安全基準", "品質基準", "環境に優しい", "工具不要", "組立不要", "完成品", "マスターキー", "機内持込", "機内持ち込み", "360度", "キャスター", "エンボス加工",
    "メッシュポケット", "クロスベルト", "高さ調節", "段階調節", "キャリーバー", "側面ハンドル", "底足", "tsaロック", "ダイヤルロック", "abspc", "abs樹脂", "pc混合樹脂",
    "ベージュ", "ブラック", "ホワイト", "グレー", "シルバー", "レッド", "ブルー", "グリーン", "ピンク", "abs", "樹脂", "アメリカ運輸保安局", "認可", "施錠したまま", "セキュリティチェック",
    "鍵を壊さず", "鍵を傷つけず", "検査が可能", "静音", "消音",
)
#: Sections of a description in their order, with their titles (fixed values).
SECTIONS = {"overview": "商品概要", "features": "特徴・ベネフィット", "specifications": "商品仕様", "use_cases": "使用シーン・おすすめ", "care_and_cautions": "お手入れ・注意事項"}
#: Headings: pattern, section, and whether the line itself stays (fixed values).
HEADINGS = (
    ("^(商品概要|商品説明|概要|イントロ)$", "overview", False),
    ("^(商品仕様|商品スペック|スペック)$", "specifications", False),
    ("^(使用シーンおすすめ|おすすめの使用シーン|こんな方におすすめ|対応シーン)$", "use_cases", False),
    ("^(お手入れ注意事項|品質お手入れについて)$", "care_and_cautions", False),
    ("^(特徴ベネフィット|特徴|特長|注目のポイント)$", "features", False),
    ("サイズ重量|素材構造|梱包情報", "specifications", True),
    ("使用シーン|多用途", "use_cases", True),
    ("お手入れ|注意事項|ご注意|品質|保証", "care_and_cautions", True),
    ("特徴|特長|ポイント|機能|モード|設計|収納|キャスター|ハンドル|安全|快適", "features", True),
)
#: Prefixes of validation errors and the kind of what follows them (fixed values).
ERROR_KINDS = {
    "Generated copy includes unsourced numeric fact: ": "numeric",
    "Generated copy includes hard fact without trusted-fact evidence: ": "hard_fact",
    "Generated copy includes prohibited claim: ": "prohibited",
    "unsupported hard claim: ": "unsupported_audit",
}
ISSUE = "array<struct<kind:string,needle:string>>"


@pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, Arrow batch by batch."""
    return c.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@pandas_udf(ArrayType(ArrayType(StringType())))
def nfkc_terms(c: pd.Series) -> pd.Series:
    """The same for lists of terms."""
    return c.map(lambda xs: None if xs is None else [[None if x is None else unicodedata.normalize("NFKC", x) for x in ts] for ts in xs])


def in_nfkc(c: Column) -> Column:
    """The same, but texts in ASCII, which it leaves as they are, don't go to Python."""
    return F.coalesce(nfkc(F.when(F.octet_length(c) != F.char_length(c), c)), c)


def compact(c: Column) -> Column:
    """Lower case without white space, of a text in NFKC."""
    return F.regexp_replace(F.lower(c), "[\\s　]+", "")


def bare(c: Column) -> Column:
    """The same without the marks between words and around headings. A class of characters
    beyond ASCII is tried member by member at each character, so it's only used on texts
    that have one of its blocks."""
    plain = F.regexp_replace(F.lower(c), "[ \\t\\n\\x0B\\f\\r|:,()]+", "")
    return F.when((F.octet_length(c) == F.char_length(c)) | ~c.rlike("[\u3000-\u30ff\uff00-\uff1f]"), plain).otherwise(F.regexp_replace(F.lower(c), "[\\s　|・:：,【】「」『』()（）]+", ""))


def sizes_in(c: Column) -> Column:
    """Size labels that a title states, in order of size."""
    t = F.upper(c)
    return F.array_compact(F.array(*[F.when(t.rlike(f"(^|[^A-Z]){s}\\s*(サイズ|SIZE)($|[^A-Z])"), s) for s in SIZES]))


def trip_length(c: Column) -> Column:
    """Nights or days that a title names: a range, two next to each other, or one."""
    part = lambda p, i: F.regexp_extract(c, p, i)
    span, twice, once = "(\\d+)\\s*[～〜~\\-－–—]\\s*(\\d+)\\s*(泊|日)", "(\\d+)\\s*(泊|日)\\s*(\\d+)\\s*\\2", "(\\d+)\\s*(泊|日)"
    label = lambda p, a, b, unit: F.concat(part(p, a), F.lit("～"), part(p, b), part(p, unit))
    return F.when(c.rlike(span), label(span, 1, 2, 3)).when(c.rlike(twice), label(twice, 1, 3, 2)).when(c.rlike(once), F.concat(part(once, 1), part(once, 2)))


def title_tokens(c: Column) -> Column:
    """At most ten tokens of 2 to 24 characters of a title, stop words left out."""
    words = F.split(c, "[\\s　／/・,，、【】［］()（）]+")
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w).between(2, 24) & ~w.isin(*TITLE_STOP))), 1, 10)


def evidence_terms(c: Column) -> Column:
    """Terms that stand for a value as evidence: a short one itself, else at most eight
    bracketed terms, measures and short phrases."""
    phrases = F.transform(F.split(c, "[。\\n]"), lambda p: F.trim(F.regexp_replace(p, "^[・\\d.\\s]+", "")))
    found = F.concat(F.regexp_extract_all(c, F.lit("【([^】]{2,24})】"), F.lit(1)), F.regexp_extract_all(c, F.lit("(?i)\\d+(?:\\.\\d+)?\\s?(?:cm|mm|kg|g|L|ml|個|枚|台|段|人|歳)"), F.lit(0)), F.filter(phrases, lambda p: F.length(p).between(2, 32)))
    return F.when(F.length(c) <= 48, F.array(c)).otherwise(F.slice(F.array_distinct(found), 1, 8))


def plain_numbers(c: Column) -> Column:
    """Numbers without leading zeros and without zeros at the end of their fractions."""
    t = F.regexp_replace(c, "(?<![\\d.])0+(?=\\d)", "")
    return F.regexp_replace(F.regexp_replace(t, "(\\.\\d*?[1-9])0+(?!\\d)", "$1"), "(\\d)\\.0+(?!\\d)", "$1")


#: Units of numbers that evidence names (fixed values).
ALIAS_UNITS = "cm|mm|kg|g|L|ml|個|枚|台|段階|日|泊"


def _plain_number(number: Column) -> Column:
    whole = F.regexp_replace(number, "^0+(?=\\d)", "")
    return F.when(F.contains(whole, F.lit(".")), F.regexp_replace(whole, "\\.?0+$", "")).otherwise(whole)


def canonical_numbers(c: Column) -> Column:
    """Every number of a text in its plain form, in one pass over its parts: "1.50.07" is
    1.50, a point and 07. All digits stay, however many."""
    parts = F.regexp_extract_all(c, F.lit("\\d+(?:\\.\\d+)?|\\D+"), F.lit(0))
    return F.when(c.rlike("\\d"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^\\d"), _plain_number(p)).otherwise(p)), "")).otherwise(c)


def number_aliases(c: Column) -> Column:
    """Each number with a unit of ALIAS_UNITS, as its plain form and the unit next to it;
    of units that start alike the first listed counts."""
    pattern = F.lit(f"(?i)(\\d+(?:\\.\\d+)?)\\s*({ALIAS_UNITS})")
    pairs = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("n"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("unit"))
    return F.transform(pairs, lambda x: F.concat(_plain_number(x.n), x.unit))


def vocabulary(c: Column, known: Sequence[str], other: str = "unknown") -> Column:
    """A value of a closed vocabulary, case and outer blanks ignored."""
    v = F.lower(F.trim(c))
    return F.when(v.isin(*known), v).otherwise(other)


def scope_query(title: Column, category: Column) -> Column:
    """Search words of a listing's benchmark: its sizes for a suitcase, else its category
    and at most three segments that the category doesn't name."""
    sizes = F.transform(sizes_in(title), lambda s: F.concat(s, F.lit("サイズ")))
    lock = F.when(title.rlike("(?i)TSA"), F.array(F.lit("TSAロック"))).otherwise(F.array().cast("array<string>"))
    suitcase = F.array_join(F.concat(F.array(F.lit("スーツケース")), sizes, F.array(F.lit("キャリーケース")), lock), " ")
    named = F.array_compact(F.array(*[F.nullif(F.regexp_extract(title, p, 0), F.lit("")) for p in SEGMENTS]))
    extra = F.slice(F.filter(named, lambda s: ~F.contains(compact(category), compact(s))), 1, 3)
    return F.when(title.rlike("(?i)スーツケース|キャリーケース|キャリーバッグ|suitcase"), suitcase).when(F.trim(category) != "", F.array_join(F.array_distinct(F.concat(F.array(F.trim(category)), extra)), " "))


def scope_key(query: Column) -> Column:
    return F.concat(F.lit("query:"), F.substring(F.sha2(compact(query), 256), 1, 16))


def lenient_json(c: Column) -> Column:
    """The JSON object in a model's answer: without a code fence around it, else from its
    first to its last brace; null if there is none."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "(?i)^```(?:json)?\\s*", ""), "```$", ""))
    inner = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull() & F.trim(x).startswith("{")
    return F.when(valid(t), t).when(valid(inner), inner)


def issues_of(errors: Column) -> Column:
    """(kind, needle) of the errors that name something to be removed."""
    def one(e: Column) -> Column:
        out = F.lit(None).cast("struct<kind:string,needle:string>")
        for prefix, kind in ERROR_KINDS.items():
            needle = F.trim(F.substring(e, F.lit(len(prefix) + 1), F.length(e)))
            out = F.when(e.startswith(prefix) & (needle != ""), F.struct(F.lit(kind).alias("kind"), needle.alias("needle"))).otherwise(out)
        return out

    return F.array_distinct(F.array_compact(F.transform(errors, one)))


def _comparable_issue(issue: Column, needle: Column) -> Column:
    """An issue with what it is looked for by: the compact form of its needle (in NFKC), and
    for an audit's claim its tokens."""
    tokens = F.filter(F.transform(F.split(needle, "[\\s　:：,，、。・()（）【】「」]+"), compact), lambda t: F.length(t) >= 2)
    return F.struct(issue.kind.alias("kind"), issue.needle.alias("needle"), compact(needle).alias("c"), F.when(issue.kind == "unsupported_audit", tokens).otherwise(F.array().cast("array<string>")).alias("tokens"))


def _has(text: Column, i: Column) -> Column:
    """Whether a compact text has an issue's needle, or for an audit's claim all its tokens."""
    every = (F.size(i.tokens) > 0) & F.forall(i.tokens, lambda t: F.contains(text, t))
    return ((i.c != "") & F.contains(text, i.c)) | every


def flagged(value: Column, issues: Column) -> Column:
    """Whether an issue flags a text in NFKC."""
    return _bound(compact(value), lambda text: F.exists(issues, lambda i: _has(text, i)))


def repair_parts(df: DataFrame, title: str, description: str, issues: str) -> DataFrame:
    """Adds what repaired() works on: the title's words and the description's sentences and
    clauses as they are, and the NFKC form of each and of the issues' needles beside them.
    The text itself stays as it was written; only comparisons are in NFKC."""
    words = F.filter(F.split(F.coalesce(F.col(title), F.lit("")), "[\\s　]+"), lambda w: w != "")
    pairs = lambda c, pattern: F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("end"))
    sentences = F.filter(pairs(F.coalesce(F.col(description), F.lit("")), "([^。！？\n]+)([。！？\n]+|$)"), lambda s: F.trim(s.t) != "")
    parted = F.transform(sentences, lambda s: F.struct(s.t.alias("t"), s.end.alias("end"), pairs(s.t, "([^、，,；;]*)([、，,；;]|$)").alias("clauses")))
    x = df.withColumns({"__w": words, "__s": parted})
    raw = F.concat(F.array("__w", F.transform("__s", lambda s: s.t), F.transform(issues, lambda i: i.needle)), F.transform("__s", lambda s: F.transform(s.clauses, lambda c: c.t)))
    return x.withColumn("__n", nfkc_terms(raw))  # words, sentences, needles, then the clauses of each sentence


def repaired(df: DataFrame, issues: str, audits_in_all: bool = False) -> DataFrame:
    """repair_parts() -> adds repaired_title, repaired_description, n_removed (words and
    clauses taken out) and unresolved (issues that what is left still has).

    A sentence that no issue names stays as it is. With ``audits_in_all`` an audit's claim with
    tokens counts as named in every sentence: clauses go by the same tests, but all sentences
    lose the marks and white space at their ends, and those of nothing else go."""
    n = F.col("__n")
    x = df.withColumn("__i", F.transform(F.arrays_zip(F.col(issues).alias("i"), n[2].alias("needle")), lambda x: _comparable_issue(x.i, x.needle)))
    edge = "^[、，,；;\\s]+|[、，,；;\\s]+\\z"
    good = F.filter(F.arrays_zip(F.col("__w").alias("w"), n[0].alias("n")), lambda p: ~flagged(p.n, F.col("__i")))

    def sentence(s: Column, i: Column) -> Column:
        named = lambda text, issue: _has(text, issue) | (F.size(issue.tokens) > 0) if audits_in_all else _has(text, issue)
        mine = _bound(compact(n[1][i]), lambda text: F.filter("__i", lambda issue: named(text, issue)))
        whole = F.struct(F.concat(s.t, s.end).alias("t"), F.concat(n[1][i], s.end).alias("n"), F.lit(0).alias("removed"))

        def clauses(issues_: Column) -> Column:
            zipped = F.transform(F.arrays_zip(s.clauses.alias("c"), F.get(n, i + 3).alias("n")), lambda c: F.struct(c.c.t.alias("t"), c.c.end.alias("end"), c.n.alias("n"), flagged(c.n, issues_).alias("bad")))
            return F.when(F.size(issues_) == 0, whole).otherwise(_bound(zipped, lambda cs: result(cs, issues_)))

        def result(cs: Column, issues_: Column) -> Column:
            kept = F.filter(cs, lambda c: ~c.bad)
            left = F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda c: F.concat(c.t, c.end)), ""), edge, ""))
            still = flagged(F.array_join(F.transform(kept, lambda c: F.concat(c.n, c.end)), ""), issues_)
            removed = F.size(F.filter(cs, lambda c: c.bad & (F.trim(c.t) != "")))
            return _bound(F.struct(left.alias("left"), still.alias("still")), lambda r: F.when(r.still, F.struct(F.lit("").alias("t"), F.lit("").alias("n"), (removed + 1).alias("removed"))).otherwise(
                F.struct(F.when(r.left == "", "").otherwise(F.concat(r.left, s.end)).alias("t"), F.when(r.left == "", "").otherwise(F.concat(F.trim(F.regexp_replace(F.array_join(F.transform(kept, lambda c: F.concat(c.n, c.end)), ""), edge, "")), s.end)).alias("n"), removed.alias("removed"))))

        return _bound(mine, clauses)

    x = x.withColumns({"__good": good, "__d": F.transform("__s", sentence)})
    whole = F.array_join(F.transform("__d", lambda d: d.t), "")
    text = F.trim(F.regexp_replace(F.regexp_replace(whole, "\n{3,}", "\n\n"), edge, ""))
    rest = compact(F.concat_ws("\n", F.array_join(F.transform("__good", lambda p: p.n), " "), F.regexp_replace(F.array_join(F.transform("__d", lambda d: d.n), ""), edge, "")))
    counts = F.size("__w") - F.size("__good") + F.aggregate("__d", F.lit(0), lambda acc, d: acc + d.removed)
    done = x.withColumns({"repaired_title": F.array_join(F.transform("__good", lambda p: p.w), " "), "repaired_description": text, "n_removed": counts.cast("long"), "__rest": rest})
    left = _bound(F.col("__rest"), lambda text: F.filter("__i", lambda i: _has(text, i)))
    return done.withColumn("unresolved", F.transform(left, lambda i: F.struct(i.kind.alias("kind"), i.needle.alias("needle")))).drop("__w", "__s", "__n", "__i", "__good", "__d", "__rest")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it's used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def heading(line: Column) -> Column:
    """(section, retain) if the line is a heading, else null. Line in NFKC."""

    def of(t: Column) -> Column:
        bracketed = t.rlike("^[【\\[][^】\\]]+[】\\]]$")
        inner = F.when(bracketed, F.regexp_extract(t, "^[【\\[]([^】\\]]+)[】\\]]$", 1))
        plain = F.when((F.length(t) <= 24) & ~t.rlike("[。:：]|^[・●■\\-]"), t)
        return _bound(bare(F.coalesce(inner, plain)), by_name)

    def by_name(name: Column) -> Column:
        out = F.lit(None).cast("struct<section:string,retain:boolean>")
        for pattern, section, retain in reversed(HEADINGS):
            out = F.when(name.rlike(pattern), F.struct(F.lit(section).alias("section"), F.lit(retain).alias("retain"))).otherwise(out)
        return F.when(F.length(name).between(1, 30), out)

    return _bound(F.regexp_replace(F.trim(line), "^#+\\s*", ""), of)


def section_lines(text: Column) -> Column:
    """array<struct<section, line, b>> of a visible text in NFKC: each line and its bare form
    under the heading before it (overview before the first), headings only where they stay."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    code = lambda section: F.substring(section, 1, 1)
    named = F.create_map(*[F.lit(x) for s in SECTIONS for x in (s[0], s)])
    zero = F.struct(F.lit("o").alias("now"), F.lit("").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        now = F.coalesce(code(h.section), acc.now)
        return F.struct(now.alias("now"), F.concat(acc.out, F.when(F.coalesce(h.retain, F.lit(True)), now).otherwise("-")).alias("out"))

    def place(xs: Column) -> Column:
        # One letter a line: what a fold has gathered is copied at each of its steps.
        codes = F.aggregate(F.transform(xs, heading), zero, step, lambda acc: acc.out)
        return _bound(codes, lambda cs: F.array_compact(F.transform(xs, lambda x, i: one(x, F.substring(cs, i + 1, F.lit(1))))))

    def one(x: Column, c: Column) -> Column:
        return F.when(c != "-", F.struct(F.element_at(named, c).alias("section"), x.alias("line"), bare(x).alias("b")))

    return _bound(lines, place)


def unique_lines(placed: Column) -> Column:
    """Placed lines without those whose bare form came before, or is empty."""
    bares = F.transform(placed, lambda x: x.b)
    return _bound(bares, lambda bs: F.filter(placed, lambda x, i: (x.b != "") & (F.array_position(bs, x.b) == i + 1)))


def _in_section(placed: Column, section: str) -> Column:
    return F.filter(placed, lambda x: x.section == section)


def of_section(placed: Column, section: str) -> Column:
    return F.transform(_in_section(placed, section), lambda x: x.line)


def specifications(lines: Column) -> Column:
    """array<struct<label, value, plain>> of specification lines: cells or "label: value"; of a
    label's values with one bare form the first. ``plain`` is the form that values compare
    by: bare, without the label that it may start with."""
    pattern = "^([^:：]{1,20})[:：]\\s*(.+)$"

    def one(raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, "^[・●■\\-]\\s*", ""))
        cells = F.filter(F.transform(F.split(line, "\\|"), lambda c: F.trim(c)), lambda c: c != "")
        return _bound(F.struct(line.alias("line"), cells.alias("cells")), split)

    def split(x: Column) -> Column:
        label = F.when(F.size(x.cells) >= 2, F.element_at(x.cells, 1)).otherwise(F.regexp_extract(x.line, pattern, 1))
        value = F.when(F.size(x.cells) >= 2, F.element_at(x.cells, -1)).otherwise(F.regexp_extract(x.line, pattern, 2))
        return _bound(F.struct(label.alias("label"), value.alias("value")), lambda s: F.when((s.label != "") & (s.value != "") & ~s.value.rlike("商品詳細をご確認|ご参照ください"), F.struct(bare(s.label).alias("label"), s.value.alias("value"), bare(s.value).alias("b"))))

    def first(found: Column) -> Column:
        keys = F.transform(found, lambda x: F.struct(x.label, x.b))
        return _bound(keys, lambda ks: F.transform(F.filter(found, lambda x, i: F.array_position(ks, F.struct(x.label, x.b)) == i + 1), lambda x: F.struct(x.label.alias("label"), x.value.alias("value"), plain(x).alias("plain"))))

    def plain(x: Column) -> Column:
        return F.when(F.startswith(x.b, x.label), F.substring(x.b, F.length(x.label) + 1, F.length(x.b))).otherwise(x.b)

    stated = F.filter(lines, lambda x: F.contains(x, F.lit("|")) | F.contains(x, F.lit(":")) | F.contains(x, F.lit("：")))
    return _bound(F.array_compact(F.transform(stated, one)), first)


def conflict_values(before: Column, after: Column) -> Column:
    """array<struct<label, source_values, enrichment_value>>: each value of ``after`` that
    differs from values that ``before`` has under its label, with these; by label in the
    order of ``after``. Both are specifications()."""
    labels = F.array_distinct(F.transform(after, lambda a: a.label))
    different = lambda a: F.transform(F.filter(before, lambda b: (b.label == a.label) & (b.plain != a.plain)), lambda b: b.value)
    clash = lambda a: F.struct(a.label.alias("label"), different(a).alias("source_values"), a.value.alias("enrichment_value"))
    every = F.flatten(F.transform(labels, lambda l: F.transform(F.filter(after, lambda a: a.label == l), clash)))
    return F.filter(every, lambda c: F.size(c.source_values) > 0)


def conflicts(before: Column, after: Column) -> Column:
    """Labels of ``after`` whose value differs from one that ``before`` has."""
    return F.array_distinct(F.transform(conflict_values(before, after), lambda c: c.label))


def source_blocks(placed: Column) -> Column:
    """Placed lines of a text that a proposal has to keep: section by section, once each."""
    return F.flatten(F.array(*[unique_lines(_in_section(placed, s)) for s in SECTIONS]))


def missing_blocks(blocks: Column, proposed: Column, made_of: Column) -> Column:
    """Lines of the blocks whose bare form a proposed text (in NFKC) has lost. ``made_of`` are
    placed lines that the text has whole: blocks among these aren't looked for in it."""
    bares = lambda c: F.transform(c, lambda x: x.b)
    rest = lambda others: _bound(bare(proposed), lambda text: F.filter(blocks, lambda x: F.array_contains(others, x.b) & ~F.contains(text, x.b)))
    none = F.array().cast("array<string>")
    return _bound(F.array_except(bares(blocks), bares(made_of)), lambda others: F.when(F.size(others) == 0, none).otherwise(F.transform(rest(others), lambda x: x.line)))


def composed(source: Column, addition: Column) -> Column:
    """Both placed texts under the titles of all sections, repeated lines once."""
    lines = lambda s: F.transform(unique_lines(F.concat(_in_section(source, s), _in_section(addition, s))), lambda x: x.line)
    parts = [F.concat(F.lit(f"【{title}】\n"), F.array_join(lines(s), "\n")) for s, title in SECTIONS.items()]
    return F.concat_ws("\n\n", *parts[:-1], F.regexp_replace(parts[-1], "\\s+$", ""))


def new_claims(source: Column, text: Column) -> Column:
    """Prohibited claims and hard facts that a text has and its source hasn't. Those with
    characters beyond U+3000 are only looked for in texts with such characters."""
    wide = [f for f in PROHIBITED + HARD_FACTS if max(f) >= "\u3000"]
    narrow = [f for f in PROHIBITED + HARD_FACTS if f not in wide]
    of = lambda fs: F.array(*map(F.lit, fs))
    named = F.when(text.rlike("[^\\x{0}-\\x{2fff}]"), of(narrow + wide)).otherwise(of(narrow))
    return _bound(F.struct(F.lower(text).alias("text"), F.lower(source).alias("known")), lambda x: F.filter(named, lambda f: F.contains(x.text, f) & ~F.contains(x.known, f)))


def says_any(text: Column, claims: Column) -> Column:
    """Whether a text has one of the claims, case ignored."""
    return (F.size(claims) > 0) & _bound(F.lower(text), lambda x: F.exists(claims, lambda f: F.contains(x, f)))


def proposal_errors(title: Column, description: Column, source_title: Column, source_description: Column, confidence: Column, evidence: Column) -> Column:
    """What is wrong with a proposal: values out of range, blanks, lengths, no change,
    numbers, prohibited claims, and facts without evidence."""
    text = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    known = F.lower(evidence)
    blank = lambda c: c.isNotNull() & (F.trim(c) == "")
    changed = (title.isNotNull() & ~title.eqNullSafe(source_title)) | (description.isNotNull() & ~description.eqNullSafe(source_description))
    none = title.isNull() & description.isNull()
    rules = [
        F.when(confidence.isNull() | ~confidence.between(0, 1), "confidence must be a number between 0 and 1"),
        F.when(blank(title), "suggested title must not be blank when non-null"),
        F.when(blank(description), "suggested description must not be blank when non-null"),
        F.when(F.length(title) > 127, "suggested title exceeds 127 characters"),
        F.when(F.length(description) > 5000, "suggested description exceeds 5000 characters"),
        F.when(~none & ~blank(title) & ~blank(description) & ~changed, "proposal makes no material change to title or description"),
    ]
    numbers = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(MEASURES), F.lit(0))), lambda n: ~F.contains(known, F.lower(n)))
    unsourced = F.transform(numbers, lambda n: F.concat(F.lit("Generated copy includes unsourced numeric fact: "), n))
    claims = [F.when(F.contains(text, F.lit(c)), f"Generated copy includes prohibited claim: {c}") for c in PROHIBITED]
    facts = [F.when(F.contains(text, F.lit(c)) & ~F.contains(known, F.lit(c)), f"Generated copy includes hard fact without trusted-fact evidence: {c}") for c in HARD_FACTS]
    return F.concat(F.array_compact(F.array(*rules)), unsourced, F.array_compact(F.array(*claims)), F.array_compact(F.array(*facts)))
