"""Queries against their SQL on texts where Java and RE2 read regular expressions differently."""

import pytest
from conftest import oracle_rows, spark_rows

from opinara.plans.deeper import ORACLES, QUERIES

ODD = {
    "competitor_mentions": [
        "preguntañas | asieie, | I replaced Acme with Globex.",  # SQL's "as" begins after ñ
        "as we said I moved from Acme to Globex because it works",
        "We choose Globex as\x0bit is cheap. I choose Acme since  it is good \t",
        "leaving\u0085Acme for Globex because it is slow\t", "switch to Acme\rsince ever", "éAcme and Acmeé are not Acme",
        "Acmé acme² ACME", "I choose İnitech, or choose ınitech; ınıtech INITECH", "ſwitch to Globex, xſwitch to Acme",
        "émoving to Globex because I can", "we choose Globex, as", "no end because\nI choose Acme since yes\nand Globex", "Globex", None, "",
    ],
    "pii_redact": [
        "call 2125550100 +442071234567 now", "2125550100,2125550101,2125550102", "2125550100\n2125550101", "+1 (212) 555-0100\n", "(212) 555-0100",
        "é2125550100 2125550100² 2125550100_ ٣2125550100", "ñann.lee@example.comé", "a@b.com.c@d.ef", "x@y.deß @ann@lee.org", "ann@example.coſ",
        "$1 2125550100 \\ann@example.com", "12345678 123456789", None, "",
    ],
}


@pytest.mark.parametrize("name", sorted(ODD))
def test_odd_texts_equal_oracle(spark, tmp_path, name):
    # ids that keep their texts, and ids that are not deleted
    ids = [k for k in range(1, 1000) if k % 5 and k % 23]
    docs = [(k, t, "en", "web", len(t or "")) for k, t in zip(ids, ODD[name])]
    for table, rows, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", [(3000, 0, 0)], "doc_id long, quality int, toxic int")):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(str(tmp_path / f"{table}.parquet"))
    columns, rows = spark_rows(QUERIES[name](spark, str(tmp_path)))
    assert rows == oracle_rows(ORACLES[name], columns, str(tmp_path)) and rows
