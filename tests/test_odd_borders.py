"""Values beside letters with accents and other odd characters, as their SQL has them."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare

import __spark_entry__

TEXTS = [
    "EN 4886é and ISO 9001ß, éEN 12 and éFDA, FDAé", "wARNİNG warnıng CAUTIOŃ DANGERé éDANGER", "10 KPa and 5 pſi, 7 baŕ", "iſo 14 and IſO\x0b15 and ISO\xa016 ISO\f17",
    "5 μm 6 µm 7 Μm 8 µMé", "Acme\x0bGmbH and Éacme Ltd Foo Ltdé Acme\nSA", "GHſ07 EUH066é H301́ P264", "12 °C é13 °Cé 14 °C5 15%é", "density 1.5 g/cm³x density 2 g/cm³ density 3 kg/m³5 ſhelf life 3 monthſ",
    "maiſe cornée cornerice éoats crop Zea mayſ crop ſea Wheat\x0brice soybeané", "",
]


@pytest.mark.parametrize("name", ["technical_values", "safety_facts", "farm_entities"])
def test_borders_of_sql(spark, tmp_path, name):
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS}), tmp_path / "documents.parquet")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    assert compare(df, __spark_entry__.oracle_sql()[name], str(tmp_path)) is None
