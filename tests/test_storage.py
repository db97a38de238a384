from __future__ import annotations

from pathlib import Path

import pytest

from tessera.storage import materialize, release


def folder(table) -> Path:
    return Path(table._tessera_path.removeprefix("file:"))


def test_tables_have_no_checksum_files(spark):
    table = materialize(spark.range(100, numPartitions=4), "numbers")
    assert sorted(r["id"] for r in table.collect()) == list(range(100))
    assert len(list(folder(table).glob("part-*.parquet"))) == 4 and not list(folder(table).glob(".*.crc"))
    release(table)


def test_a_damaged_table_is_not_read(spark):
    table = materialize(spark.range(1000, numPartitions=1).selectExpr("id", "sha2(string(id), 256) AS text"), "damaged")
    file = next(folder(table).glob("part-*.parquet"))
    raw = bytearray(file.read_bytes())
    raw[len(raw) // 2] ^= 1
    file.write_bytes(raw)
    for crc in folder(table).glob(".*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="(?i)checksum|crc"):
        table.collect()
    release(table)
