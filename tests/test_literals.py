"""Literal cases of forms that the tables hold no example of: entities, dates, masks, answers, extraction records, policies."""

import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from vestigraph.functions import text as tx
from vestigraph.operators import documents, evaluation, ingest, projection, rules, versions

_NAMED = [(1, 0, "华辰智能有限公司 hired 张伟先生 for $ 3000 元 on 2024-03-05"), (2, 100, "AcmeInc. and BetaLLC"), (3, 0, "李雷 教授 2023年5月1日 2023 年度 12.5 亿 美元"), (4, 0, ""), (5, 0, None), (6, 7, "no names, 5 dollars")]
_FOUND = [
    (1, "ORG", "华辰智能有限公司", 0, 8, 0.85), (1, "PERSON", "张伟", 15, 17, 0.7), (1, "MONEY", "$ 3000 元", 24, 32, 0.85), (1, "DATE", "2024-03-05", 36, 46, 0.7), (2, "ORG", "AcmeInc.", 100, 108, 0.85), (2, "ORG", "BetaLLC", 113, 120, 0.85),
    (3, "PERSON", "李雷", 0, 2, 0.7), (3, "MONEY", " 12.5 亿 美元", 23, 33, 0.85), (3, "DATE", "2023年5月1日", 6, 15, 0.7), (3, "DATE", "2023 年", 16, 22, 0.7),
]

_DATED = ["报告期：2024年3月", "2023-06-30", "本办法自2025年1月2日起施行", "截至 2022-12-31，共计", "2021年度 发布", "签署日期：1999-13-40", "no date"]

_ENDING = [("本办法有效期至2027年12月31日。", "2027-12-31"), ("合同有效期至2027-01-01\n本制度自2024-01-01起施行", None), ("本规定有效期截止至 2028年6月", "2028-06-30"), ("本细则\n有效期至2027-01-01", None), ("本制度有效期到2125年度", None), ("本制度有效期至2025-02-30\n本制度有效期至：2026.3.4", "2026-03-04"), ("", None)]

_MENTIONED = [("Alpha pays Beta", "Beta", 11, 11), ("Alpha pays Beta", "Beta", 3, 11), ("Alpha pays Beta", "Beta", None, 11), ("Alpha pays Beta", "Gamma", 0, None), ("", "x", 0, None)]

_VERDICTS = [("recall", 1.0, 1.0, True, 0.8609, False), ("fpr", 0.0, 0.05, False, 0.1391, False), ("gain", 0.1428, 0.1, True, None, True), ("hops", 0.8333, 0.9, True, None, False), ("cost", None, 8000.0, False, None, False), ("coverage", 1.0, 1.0, True, 1.0, False), ("open", 0.5, None, True, None, False)]

_MASKED = [("amount", "1,234,567.89", "***,***.00"), ("amount", " ", ""), ("invoice", "INV 2024 0315 0001", "INV2****0001"), ("invoice", "INV1", "****"), ("account", "６２２８4800 1234", "6228 **** 1234"), ("account", "12345678", "****"), ("account", "6228480012341234567", "6228 **** **** **** 4567"), ("phone", "+86 138-1234-5678", "861****5678"), ("phone", "1234567", "****")]
_HASHED = [("filename", "a.pdf", "a.pdf"), ("hashed", "110101 1990-0307", "salt|1101011990" + "0307"), ("hashed", "Jörg Öz", "salt|jörgöz")]

_LOGGED = [(1, '{"amount": "5", "note": "x", "who": {"phone": "13812345678", "deep": [{"tax_id": "A1"}, "13812345678"]}, "n": 3}', '{"amount": "***,***.00", "note": "x", "who": {"phone": "138****5678", "deep": [{"tax_id": "@"}, "13812345678"]}, "n": 3}'), (2, "[1]", "****"), (3, "oops", "****"), (4, None, None), (5, '{"secret": "s"}', '{"secret": "****"}')]

_NAMES = [("北京恒信达科技股份有限公司", "北京恒信达科技"), ("北京 恒信达　科技有限公司", "北京恒信达科技"), ("股份有限公司", "股份"), ("公司", "公司"), ("ＡＢＣ Ｌｔｄ有限责任公司", "ABCLtd"), ("", ""), (None, "")]
_ADDRESSES = [("上海市，浦东新区（张江）1－2号", "上海市浦东新区张江12号"), ("No. 5/A, Main-Street!", "No5AMainStreet"), (None, "")]

_ANSWERS = [('{"entities": []}', '{"entities": []}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('Here it is: {"a": {"b": 2}} as asked', '{"a": {"b": 2}}'), ("[1, 2]", None), ("no json", None), ("", None), (None, None), ('{"a": 1} and {"b": 2}', None), ("{broken", None)]

_RECORDS = [
    ("d", 1, "公司", "甲", {"行业": "软件"}, True), ("d", 2, "财务指标", "营收 3 亿", {"主体": "甲", "指标名称": "营收"}, True), ("d", 3, "业务板块", "云服务", {"主体": "乙"}, False), ("d", 4, "控股关系", "甲控股丙", {"主体": "甲", "标的": "丙", "关系类型": "控股", "比例": "51%"}, True),
    ("d", 5, "控股关系", "甲控股丙", {"主体": "甲", "标的": "丙", "关系类型": "控股", "比例": "51%"}, True), ("d", 6, "控股关系", "丁", {"主体": "甲"}, True), ("d", 7, "控股关系", "无主", {}, True), ("d", 8, "业务板块", "甲", {"主体": "甲"}, True), ("d", 9, None, "丙", {}, True), ("d", 10, "公司", "  ", {}, True),
]
_EXTRACTED = [
    ("entity", "甲", "公司", "true false", ""), ("entity", "营收 3 亿", "财务指标", "true false", ""), ("entity", "营收", "财务指标", "false true", ""), ("entity", "云服务", "业务板块", "false false", ""), ("entity", "乙", "公司", "false true", ""), ("entity", "丙", "公司", "false true", ""), ("entity", "丁", "公司", "false true", ""),
    ("relation", "甲", "具有财务指标", "营收", "true"), ("relation", "乙", "经营业务板块", "云服务", "true"), ("relation", "甲", "控股", "丙", "false"), ("relation", "甲", "关联", "丁", "false"),
]

_CONSISTENT = [("a", "v1", True, "v1"), ("b", "v1", False, "v1"), ("c", "v1", None, None), ("d", None, None, "v1"), ("e", "v2", True, "v1"), ("f", "", None, "")]

_POLICY = [(1, 1, "标准工时制：周工作超过 44 小时的为高风险"), (1, 2, "员工每周工作 40 小时"), (2, 1, "每周工作 38 小时；月标准工时为174小时"), (2, 2, "月累计加班超过 36 小时"), (1, 3, "核心在岗时段为 10:00 至 16:30"), (2, 3, "核心时段未在岗超过 5 次"), (3, 1, "连续出勤达到 12 天，季度剩余不足15天")]
_POLICY_VALUES = [("weekly_hours_cap", 44.0, 1, 1, 1), ("monthly_standard_hours", 174.0, 2, 1, 2), ("monthly_overtime_cap", 36.0, 2, 2, 4), ("core_hours_required", 6.5, 1, 3, 5), ("core_absence_limit", 5.0, 2, 3, 7), ("consecutive_days_limit", 12.0, 3, 1, 8), ("comp_off_quarter_remaining_days", 15.0, 3, 1, 9)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_entities(spark):
    chunks = spark.createDataFrame([(i, 0, at, t) for i, at, t in _NAMED], "doc_id int, chunk_no int, char_start long, chunk string")
    assert sorted(map(tuple, documents.entities(chunks).drop("chunk_no").collect())) == sorted(_FOUND)


def test_document_dates(spark):
    rows = spark.createDataFrame(list(enumerate(_DATED)), "doc_id int, text string")
    got = {r.doc_id: r.d for r in rows.select("doc_id", documents.document_date(F.col("text"), today=F.lit("2026-01-01").cast("date")).cast("string").alias("d")).collect()}
    assert got == {0: "2024-03-31", 1: None, 2: "2025-01-02", 3: "2022-12-31", 4: "2021-12-31", 5: None, 6: None}


def test_document_expiry(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(_ENDING)], "doc_id int, text string")
    got = {r.doc_id: r.d for r in rows.select("doc_id", documents.document_expiry(F.col("text"), F.lit("2030-01-01").cast("date")).cast("string").alias("d")).collect()}
    assert got == {i: d for i, (_, d) in enumerate(_ENDING)}


def test_places_of_mentions(spark):
    rows = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(_MENTIONED)], "id int, text string, mention string, start int")
    got = {r.id: r.s for r in rows.select("id", documents.resolved_start(F.col("text"), F.col("mention"), F.col("start")).alias("s")).collect()}
    assert got == {i: x[3] for i, x in enumerate(_MENTIONED)}


def test_verdicts_and_status(spark):
    rows = spark.createDataFrame(_VERDICTS, "criterion string, value double, threshold double, higher boolean, bound double, provisional boolean")
    c, n = F.col, F.col("criterion")
    state = evaluation.status(~n.isin("recall", "open"), n != "fpr", n != "coverage", n != "gain")
    got = {r[0]: (r[1], r[2]) for r in rows.select("criterion", evaluation.judged(c("value"), c("threshold"), c("higher"), c("bound"), c("provisional")), state).collect()}
    assert got == {
        "recall": ("underpowered", "blocked"), "fpr": ("underpowered", "unknown"), "gain": ("pass_provisional", "measured_provisional"), "hops": ("fail", "measured"),
        "cost": ("indeterminate", "measured"), "coverage": ("pass", "unknown"), "open": ("indeterminate", "blocked"),
    }


@pytest.mark.parametrize(("category", "value", "want"), [*_MASKED, *((c, v, sha(w)) for c, v, w in _HASHED)])
def test_masks(spark, category, value, want):
    assert spark.range(1).select(tx.masked(F.lit(value), category, "salt")).first()[0] == want


def test_masked_payloads(spark):
    rows = spark.createDataFrame([x[:2] for x in _LOGGED], "nr int, payload string")
    got = {r.nr: r.m for r in rows.select("nr", tx.masked_json(F.col("payload"), "salt", {"secret": "unknown"}).alias("m")).collect()}
    assert got == {nr: want and want.replace("@", sha("salt|a1")) for nr, _, want in _LOGGED}


def test_normal_names_and_addresses(spark):
    for cases, f in ((_NAMES, tx.normal_name), (_ADDRESSES, tx.normal_address)):
        rows = spark.createDataFrame([(i, r[0]) for i, r in enumerate(cases)], "nr int, raw string")
        assert {r.nr: r.n for r in rows.select("nr", f(F.col("raw")).alias("n")).collect()} == {i: n for i, (_, n) in enumerate(cases)}


def test_json_in_answers(spark):
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_ANSWERS)], "nr int, answer string")
    assert {r.nr: r.o for r in rows.select("nr", tx.json_object(F.col("answer")).alias("o")).collect()} == {i: w for i, (_, w) in enumerate(_ANSWERS)}


def test_extraction_records(spark):
    records = spark.createDataFrame(_RECORDS, "doc string, nth int, kind string, text string, attributes map<string,string>, grounded boolean")
    entities, relations = ingest.from_extraction(records)
    got = [("entity", r.name, r.type, f"{r.grounded} {r.auto_created}".lower(), "") for r in entities.collect()]
    got += [("relation", r["head"], r.relation, r["tail"], str(r.derived).lower()) for r in relations.collect()]
    assert sorted(got) == sorted(_EXTRACTED)


def test_ordered_union(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a"], ["c", "b", "d"]), (2, None, ["x"]), (3, [], None)], "id int, anchors array<string>, ids array<string>")
    assert {r.id: r.u for r in rows.select("id", F.array_join(projection.ordered_union(F.col("anchors"), F.col("ids")), ",").alias("u")).collect()} == {1: "a,b,c,d", 2: "x", 3: ""}


def test_version_consistency(spark):
    rows = spark.createDataFrame(_CONSISTENT, "org string, active string, in_graph boolean, manifest string")
    got = {r.org: (r.c.code, r.c.ok, r.c.drift) for r in rows.select("org", versions.consistency(F.col("active"), F.col("in_graph"), F.col("manifest")).alias("c")).collect()}
    assert got == {"a": ("pg_graph_consistent", True, False), "b": ("ghost_version", False, False), "c": ("graph_unreachable", False, False), "d": ("no_active_version", True, False), "e": ("pg_graph_consistent", True, True), "f": ("no_active_version", True, False)}


def test_policy_values(spark):
    sources = spark.createDataFrame(_POLICY, "source_no int, segment_no int, text string")
    found = rules.first_match(sources, list(rules.POLICY_PATTERNS), ["source_no", "segment_no"])
    assert sorted(tuple(r) for r in found.select("key", "value", "source_no", "segment_no", "pattern_no").collect()) == sorted(_POLICY_VALUES)
    few = rules.first_match(sources.where("source_no != 2 and segment_no != 3"), list(rules.POLICY_PATTERNS), ["source_no", "segment_no"])
    assert {r[0] for r in rules.unresolved(few, ["weekly_hours_cap", "monthly_standard_hours", "core_hours_required", "consecutive_days_limit", "made_up"]).collect()} == {"monthly_standard_hours", "core_hours_required", "made_up"}


def plainly_cleaned(page):
    text = re.sub(r"(?i)</t[dh]\s*>", "\t", page)
    text = re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>|</(tr|p|div|li|h[1-6]|table)\s*>", "\n", text))
    text = html.unescape(text).replace("\u00a0", " ").replace("\ufeff", "")
    lines = [re.sub(r"[^\S\t]+", " ", x).strip() for x in text.splitlines()]
    noise = re.compile(documents.NOISE_LINE.replace("(?i)^page", "^[pP][aA][gG][eE]").replace("(of|/)", "([oO][fF]|/)"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x for x in lines if not x or not noise.search(x))).strip()


def test_pages_keep_what_is_no_tag(spark):
    pages = [
        "<p>caf&eacute; &#8217;s &#x41; &#146; &nbsp;x&copy y &notit; &bogus; &amp;lt;</p>", "<script>var a = 1;</script><title>T</title><!-- c --><tr><td>a</td><td>b\u3000c</td></tr>", "a\r\nb\u2028c\x0bd\x85e\x1cf",
        "<p>- 12 -</p><p>Page 3 of 9</p><p>第 3 页</p><p>text</p>\n\n\n\n\n<div>  end\t </div>", "", "&", "\ufeff\u00a0 x \u00a0",
    ]
    rows = spark.createDataFrame([*enumerate(pages), (99, None)], "id int, html string")
    got = {r.id: r.t for r in rows.select("id", documents.clean_html(F.col("html")).alias("t")).collect()}
    assert got == {i: plainly_cleaned(p) for i, p in enumerate(pages)} | {99: None}


def test_alignment_gate(spark):
    from vestigraph.operators import alignment

    rows = spark.createDataFrame([(i, "tax_id" if i < 19 else None) for i in range(20)], "id int, level string")
    assert alignment.gated(rows) is rows
    with pytest.raises(ValueError, match="18 of 19"):
        alignment.gated(rows.where("id > 0"))
    assert tuple(alignment.rate(rows.limit(0)).first()) == (0, 0, 0.0, False)
