"""Report views over the star schema: clause tables, report pages, lines, word boxes, table rows and samples.

Real reports come in through ``reportloom.sources``; these views give the operators data of the same shapes from the
tables at hand. Each view is stated twice, as a DataFrame and as the SQL that the oracle runs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERDICTS = ["P", "p", "PASS", "N/A", "n.a.", "NA", "Fail", "f", "--", "-", "—", "", "  ", "Weird", "符合", "不適用"]
IDS = ["4", "4.1", "B.2.3", "B", "G.7.3.2.1", "abc", "4.1.a", "4.1.", ":B.1;", "10.2", "4.2.1.3", "5."]
PHRASES = [
    "See appended table 5.2 for details", "see table B.3 and Supplementary information", "Reinforced Safeguard is required", "The Primary circuit requires a Safeguard",
    "SAFEGUARD and safeguard and Safeguard", "Abbreviation list.....see  below", "Clause 4.1.1 tested at 250 V and 60Hz", "Clause 4.2.1 needs 12 mm and 3.5 kV",
    "nothing at all", "", "5.4.1.8 TABLE: Electric strength tests P", "TABLE: Drop test  N/A", "B.2.5 Table: USB output voltage  F", "N/A applies to the Primary circuit",
]
ZH = [
    "一般規定: 測試條件", "元件 已評估", "激光器 外殼 外壳", "間隙和試驗電壓的乘數 (參見 4.1.2)", "表格 試驗方法 依據 標準", "電解液溢出…… 保護", "市電 點燃 防止", "標記 可辨識性 耐用性", "", "扭矩 衝擊 開口 特性", "保險絲 熔線 配線", "火勢 控制 — 方法；一",
]
TERMS = [("Reinforced Safeguard", "強化安全防護"), ("Safeguard", "安全防護"), ("Primary circuit", "一次側電路"), ("N/A", "不適用"), ("table", "表")]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


ORD = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
MARKERS = """CASE doc_id % 10 WHEN 1 THEN 'OVERVIEW OF ENERGY SOURCES AND SAFEGUARDS' WHEN 2 THEN 'ENERGY SOURCE DIAGRAM' WHEN 3 THEN 'Clause Requirement + Test Result - Remark Verdict'
 WHEN 4 THEN 'TRF No. IEC62368_1E Test Report No. RPT-' || CAST(doc_id AS STRING) WHEN 5 THEN 'TABLE: Drop test P' || chr(10) || 'Table:  Impact test N/A' WHEN 6 THEN '4.1 text P' || chr(10) || '4.2 text N/A' || chr(10) || 'B.1 more Fail'
 WHEN 7 THEN 'ES and PS and MS diagram' WHEN 8 THEN 'Report Number: R' || CAST(doc_id AS STRING) || chr(10) || 'Model/Type reference: M-' || CAST(doc_id AS STRING) || ' x' ELSE 'page' END"""

CTES = {
    "auto": f"""auto AS (SELECT l_orderkey // 100 AS doc_id, (4 + l_orderkey % 7) || '.' || (l_suppkey % 14) || '.' || l_linenumber AS clause_id,
      'Requirement ' || (l_partkey % 50) AS requirement, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE 'Result ' || CAST(l_quantity AS INT) END AS result_remark,
      CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'P' WHEN 'RF' THEN 'F' WHEN 'NO' THEN 'N/A' WHEN 'NF' THEN 'NA' WHEN 'AO' THEN '--' ELSE '' END AS verdict_raw,
      CAST(l_linenumber AS INT) AS page_number, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY {ORD}) AS seq FROM lineitem)""",
    "human": """human AS (SELECT o_orderkey // 100 AS doc_id, (4 + o_orderkey % 7) || '.' || (o_custkey % 13) || '.' || (1 + (o_orderkey // 7) % 8) AS clause_id,
      CASE o_orderstatus WHEN 'F' THEN '符合' WHEN 'O' THEN '不適用' ELSE '不符合' END AS verdict_raw, o_orderkey AS seq FROM orders)""",
    "auto_norm": """auto_norm AS (SELECT *, CASE WHEN upper(trim(verdict_raw)) IN ('P', 'PASS') THEN 'P' WHEN upper(trim(verdict_raw)) IN ('N/A', 'NA', 'N.A.') THEN 'N/A'
      WHEN upper(trim(verdict_raw)) IN ('F', 'FAIL') THEN 'Fail' ELSE '(empty)' END AS verdict FROM auto)""",
    "human_norm": "human_norm AS (SELECT *, CASE verdict_raw WHEN '符合' THEN 'P' WHEN '不適用' THEN 'N/A' ELSE 'Fail' END AS verdict FROM human)",
    "auto_first": "auto_first AS (SELECT doc_id, clause_id, verdict, seq FROM auto_norm QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY seq) = 1)",
    "human_first": "human_first AS (SELECT doc_id, clause_id, verdict, seq FROM human_norm QUALIFY row_number() OVER (PARTITION BY doc_id, clause_id ORDER BY seq) = 1)",
    "sample": f"""sample AS (SELECT ({_sql_list(VERDICTS)})[l_partkey % {len(VERDICTS)} + 1] AS verdict, ({_sql_list(IDS)})[l_suppkey % {len(IDS)} + 1] AS clause_id,
      ({_sql_list(PHRASES)})[l_orderkey % {len(PHRASES)} + 1] AS phrase, ({_sql_list(PHRASES)})[(l_orderkey + l_linenumber) % {len(PHRASES)} + 1] AS phrase2,
      ({_sql_list(ZH)})[l_partkey % {len(ZH)} + 1] AS zh, ({_sql_list(ZH)})[(l_partkey + l_linenumber) % {len(ZH)} + 1] AS zh2, CAST(l_quantity AS INT) AS n FROM lineitem)""",
    "pages_": f"""pages_ AS (SELECT doc_id // 10 AS rep_id, CAST(doc_id % 10 + 1 AS INT) AS page_number, {MARKERS} || chr(10) || text AS text FROM documents)""",
    "lines": """lines AS (SELECT rep_id, page_number, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM (SELECT rep_id, page_number, string_split(text, chr(10)) AS ls FROM pages_))""",
    "rows_": """rows_ AS (SELECT doc_id, page_number, seq, CASE WHEN page_number = 1 AND seq % 3 = 1 THEN ['Clause', 'Requirement + Test', 'Result - Remark', 'Verdict']
      WHEN seq % 5 = 0 THEN [clause_id, verdict_raw] WHEN seq % 5 = 1 THEN [clause_id, requirement, verdict_raw] WHEN seq % 5 = 2 THEN [requirement, clause_id, result_remark, verdict_raw]
      WHEN seq % 5 = 3 THEN ['', '4', requirement, ''] ELSE [clause_id, requirement, result_remark, verdict_raw] END AS cells FROM auto)""",
    "boxes": """boxes AS (SELECT rep_id, page_number, line_no, word_no, w AS text, 6.0::DOUBLE * cpos AS x0, 6.0::DOUBLE * (cpos + length(w)) AS x1, 12.0::DOUBLE * line_no + (word_no % 3) AS top, 12.0::DOUBLE * line_no + (word_no % 3) + 10 AS bottom FROM (
      SELECT rep_id, page_number, line_no, w, row_number() OVER (PARTITION BY rep_id, page_number, line_no ORDER BY k) - 1 AS word_no,
        coalesce(sum(length(w) + 1) OVER (PARTITION BY rep_id, page_number, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cpos
      FROM (SELECT rep_id, page_number, line_no, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT *, string_split(line, ' ') AS ws FROM lines)) WHERE w <> ''))""",
    "energy": """energy AS (SELECT user_id, event_id, ts, CASE event_id % 6 WHEN 0 THEN 'ES1 mains ☑' WHEN 1 THEN 'ps2 resistive lamp' WHEN 2 THEN 'moving parts [x] Thermal energy source' WHEN 3 THEN 'surface internal √' WHEN 4 THEN 'laser LED X-ray' ELSE event_type END AS line FROM events)""",
    "hits": """hits AS (SELECT doc_id, clause_id, requirement, result_remark, verdict_raw AS verdict, page_number, CASE WHEN seq % 2 = 0 THEN 0 ELSE 1 END AS pass, seq FROM auto)""",
}


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def first_rows(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


class Views:
    """The views over one folder of tables; each is planned where it is used."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def auto(self) -> DataFrame:
        key = F.floor(F.col("l_orderkey") / 100).cast("long")
        ids = F.concat((4 + F.col("l_orderkey") % 7).cast("string"), F.lit("."), (F.col("l_suppkey") % 14).cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
        verdict = F.create_map(*[F.lit(x) for x in ("AF", "P", "RF", "F", "NO", "N/A", "NF", "NA", "AO", "--")])
        return self.table("lineitem").select(
            key.alias("doc_id"), ids.alias("clause_id"), F.concat(F.lit("Requirement "), (F.col("l_partkey") % 50).cast("string")).alias("requirement"),
            F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.concat(F.lit("Result "), F.col("l_quantity").cast("int").cast("string"))).alias("result_remark"),
            F.coalesce(F.try_element_at(verdict, F.concat("l_returnflag", "l_linestatus")), F.lit("")).alias("verdict_raw"), F.col("l_linenumber").cast("int").alias("page_number"),
            F.row_number().over(Window.partitionBy(key).orderBy(*ORD.split(", "))).cast("long").alias("seq"),
        )

    @cached_property
    def human(self) -> DataFrame:
        ids = F.concat((4 + F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_custkey") % 13).cast("string"), F.lit("."), (1 + F.floor(F.col("o_orderkey") / 7) % 8).cast("string"))
        return self.table("orders").select(
            F.floor(F.col("o_orderkey") / 100).cast("long").alias("doc_id"), ids.alias("clause_id"),
            F.when(F.col("o_orderstatus") == "F", "符合").when(F.col("o_orderstatus") == "O", "不適用").otherwise("不符合").alias("verdict_raw"), F.col("o_orderkey").alias("seq"),
        )

    def _normal(self, df: DataFrame) -> DataFrame:
        from reportloom.functions.verdicts import normalize_compare

        return df.withColumn("verdict", normalize_compare(F.col("verdict_raw")))

    @cached_property
    def auto_norm(self) -> DataFrame:
        return self._normal(self.auto)

    @cached_property
    def human_norm(self) -> DataFrame:
        return self._normal(self.human)

    @cached_property
    def auto_first(self) -> DataFrame:
        return first_rows(self.auto_norm.select("doc_id", "clause_id", "verdict", "seq"), ["doc_id", "clause_id"], "seq")

    @cached_property
    def human_first(self) -> DataFrame:
        return first_rows(self.human_norm.select("doc_id", "clause_id", "verdict", "seq"), ["doc_id", "clause_id"], "seq")

    @cached_property
    def sample(self) -> DataFrame:
        part, order, line = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
        return self.table("lineitem").select(
            _pick(VERDICTS, part).alias("verdict"), _pick(IDS, F.col("l_suppkey")).alias("clause_id"), _pick(PHRASES, order).alias("phrase"), _pick(PHRASES, order + line).alias("phrase2"),
            _pick(ZH, part).alias("zh"), _pick(ZH, part + line).alias("zh2"), F.col("l_quantity").cast("int").alias("n"),
        )

    @cached_property
    def pages_(self) -> DataFrame:
        marks = F.expr(MARKERS.replace("chr(10)", "'\\n'"))
        return self.table("documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("rep_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("page_number"), F.concat(marks, F.lit("\n"), "text").alias("text"))

    @cached_property
    def lines(self) -> DataFrame:
        return self.pages_.select("rep_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))

    @cached_property
    def rows_(self) -> DataFrame:
        c = [F.col(x) for x in ("clause_id", "requirement", "result_remark", "verdict_raw")]
        head = F.array(*[F.lit(x) for x in ("Clause", "Requirement + Test", "Result - Remark", "Verdict")])
        k = F.col("seq") % 5
        cells = F.when((F.col("page_number") == 1) & (F.col("seq") % 3 == 1), head).when(k == 0, F.array(c[0], c[3])).when(k == 1, F.array(c[0], c[1], c[3])).when(k == 2, F.array(c[1], c[0], c[2], c[3])).when(k == 3, F.array(F.lit(""), F.lit("4"), c[1], F.lit(""))).otherwise(F.array(*c))
        return self.auto.select("doc_id", "page_number", "seq", cells.alias("cells"))

    @cached_property
    def boxes(self) -> DataFrame:
        """Word boxes: a character is 6 wide, a line 12 high; words of a line stand up to 2 lower.

        Lines are dealt by page before they become words, whose window then needs no shuffle of its own.
        """
        line = ["rep_id", "page_number", "line_no"]
        dealt = self.lines.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "rep_id", "page_number")
        words = dealt.select(*line, F.posexplode(F.filter(F.split("line", " "), lambda w: w != "")).alias("word_no", "text"))
        before = Window.partitionBy(*line).orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
        x0 = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
        top = 12.0 * F.col("line_no") + F.col("word_no") % 3
        return words.select("rep_id", "page_number", "line_no", "word_no", "text", (6.0 * x0).alias("x0"), (6.0 * (x0 + F.length("text"))).alias("x1"), top.alias("top"), (top + 10).alias("bottom"))

    @cached_property
    def energy(self) -> DataFrame:
        k = F.col("event_id") % 6
        line = F.when(k == 0, "ES1 mains ☑").when(k == 1, "ps2 resistive lamp").when(k == 2, "moving parts [x] Thermal energy source").when(k == 3, "surface internal √").when(k == 4, "laser LED X-ray").otherwise(F.col("event_type"))
        return self.table("events").select("user_id", "event_id", "ts", line.alias("line"))

    @cached_property
    def hits(self) -> DataFrame:
        return self.auto.select("doc_id", "clause_id", "requirement", "result_remark", F.col("verdict_raw").alias("verdict"), "page_number", F.when(F.col("seq") % 2 == 0, 0).otherwise(1).alias("pass"), "seq")
