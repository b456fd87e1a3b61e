"""The test tables seen as records of the domain: one list of expressions, read by Spark and by DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame


class View:
    """Columns of one table under the domain's names; expressions hold in both dialects."""

    def __init__(self, table: str, **columns: str):
        self.table, self.columns = table, columns

    def of(self, tables: object) -> DataFrame:
        return getattr(tables, self.table).selectExpr(*(f"{e} AS {n}" for n, e in self.columns.items()))

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table})"


def pick(column: str, *values: str, modulus: int | None = None) -> str:
    """One of the values by the column modulo their number; a value None stands for null."""
    n = modulus or len(values)
    return f"CASE ({column}) % {n} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(values)) + " END"


def quoted(*values: str | None) -> list[str | None]:
    return [v if v is None else "'" + v.replace("'", "''") + "'" for v in values]


_STAGE = pick("l_linenumber", *quoted("language_template", "headings_content", "category_similarity", "criteria_evidence"))
_VERDICT = "CASE WHEN l_partkey % 11 = 0 THEN 'DEGERLENDIRILEMEDI' WHEN l_returnflag = 'R' THEN 'KRITIK_HATA' WHEN l_returnflag = 'A' THEN 'REVIZYON' ELSE 'BASARILI' END"
#: Lines of an order as the findings of a report, with the judge's decision on each.
FINDINGS = View(
    "lineitem", report="l_orderkey", criterion="l_linenumber * 1000000 + l_partkey * 10 + l_suppkey % 10", name="concat('Kural ', CAST(l_partkey AS STRING))", stage=_STAGE, required="l_linestatus = 'F'", verdict=_VERDICT,
    rationale="concat('gerekçe ', CAST(l_suppkey AS STRING))", verifiability=pick("l_suppkey", *quoted("PDF_DENETLENEBILIR", "PDF_DENETLENEBILIR", "HARICI_KANIT_GEREKLI", "HAKEM_KONTROLU_GEREKLI")),
    page="CASE WHEN l_partkey % 5 > 0 THEN l_partkey % 60 END", quote="CASE WHEN l_partkey % 7 > 0 THEN concat('alıntı ', CAST(l_partkey AS STRING)) ELSE '' END", judge=pick("l_orderkey + l_linenumber", *quoted("approved", "rejected", "pending")),
    judge_result=pick("l_suppkey", *quoted("UYGUN", "OLUMSUZ")), reason="concat(' neden ', CAST(l_linenumber AS STRING), ' ')", mode=pick("l_partkey", *quoted("PDF_KONUMU", "RAPORDA_BULUNAMADI", None)),
    section="CASE WHEN l_suppkey % 3 = 0 THEN 'Bölüm' ELSE '' END", missing="'Yöntem'",
)
#: Parts as criteria of a profile of forty.
CRITERIA = View(
    "part", profile="CAST(floor(p_partkey / 40) AS BIGINT)", pos="p_partkey % 40", id="concat('criterion-', CAST(p_partkey AS STRING))", name="CASE WHEN p_partkey % 37 = 0 THEN ' ' ELSE concat(p_name, ' raporu') END",
    stage=pick("p_partkey", *quoted("language_template", "headings_content", "category_similarity", "criteria_evidence", "unknown", None)), required="p_size % 2 = 0", active="p_size % 10 > 0",
    description="CASE WHEN p_size % 4 = 0 THEN concat('En fazla ', CAST(p_size AS STRING), ' (sayı) sayfa olmalı') ELSE p_type END", outcome="'Puan kırılır'",
    page="CASE WHEN p_partkey % 13 > 0 THEN p_size - 3 END", quote="CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('AZAMİ ', CAST(p_size % 7 AS STRING), ' sayfa. ', p_brand) END",
    verifiability=pick("p_partkey", *quoted("PDF_DENETLENEBILIR", "HARICI_KANIT_GEREKLI", None, "HAKEM_KONTROLU_GEREKLI", "PDF_DENETLENEBILIR")), origin=pick("p_partkey", *quoted("document", "manager", "document")),
)
#: Events as calls of a model.
USAGE = View(
    "events", id="event_id", client="user_id", ts="ts", prompt="CASE WHEN event_id % 9 > 0 THEN event_id % 1000 END", candidates="CASE WHEN event_id % 7 > 0 THEN event_id % 300 END",
    thoughts="CASE WHEN event_id % 2 = 0 THEN event_id % 50 END", cached="event_type = 'view'", error="event_type = 'error'", pages="event_id % 120",
)
#: Customers as accounts.
ACCOUNTS = View(
    "customer", id="c_custkey", full_name="c_name", email="concat('  ', upper(c_name), '@Example.ORG ')", username="CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 3 = 0 THEN concat(c_name, ' (', c_mktsegment, ')') END",
    role=pick("c_custkey", *quoted("00", "01", "02", "03", "04", "99")), status=pick("c_custkey", *quoted("active", "active", "active", "revoked", "odd")), must_change="c_custkey % 2", created="c_nationkey",
)
