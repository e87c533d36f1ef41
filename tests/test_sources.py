import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseflow.session import SETTINGS, configure
from caseflow.sources import conform, load_tables, registry, table_names
from caseflow.sources.star_schema import DOMAIN_SQL, domain_tables
from tests import fixtures
from tests.conftest import DATA


def test_registry_covers_all_tables():
    assert len(table_names()) == 21 and set(DOMAIN_SQL) == set(table_names())
    assert set(fixtures.ROWS) == set(table_names())


def test_loaded_tables_follow_the_registry(tables):
    for name, schema in registry().items():
        assert [(f.name, f.dataType) for f in tables[name].schema] == [
            (f.name, f.dataType) for f in schema]


def test_casts_aliases_and_extra_columns(spark):
    schema = registry()["aus_personas"]
    raw = spark.createDataFrame(
        [(1, "CC", "9", "F", "1", "more")],
        "id int, mae_tipo_documento_codigo string, documento string, mae_sexo_codigo string,"
        " dicapacidad string, extra string")
    person = conform(raw, schema, {"dicapacidad": "discapacidad"}).first()
    assert person.asDict() == {"id": 1, "mae_tipo_documento_codigo": "CC", "documento": "9",
                               "mae_sexo_codigo": "F", "discapacidad": 1}
    with pytest.raises(ValueError, match="lacks columns"):
        conform(raw.drop("documento"), schema)


def test_bad_codes_fail_instead_of_vanishing(spark):
    raw = spark.createDataFrame([("x", 1)], "activo string, other int")
    with pytest.raises(PySparkException):
        conform(raw, StructType.fromDDL("activo int")).collect()


def test_values_that_a_cast_would_change_are_refused(spark):
    whole = spark.sql("SELECT timestamp'2024-05-01 00:00:00' AS day, 3.0D AS code")
    schema = StructType.fromDDL("day date, code int")
    assert conform(whole, schema).first()["code"] == 3
    for change in ("timestamp'2024-05-01 10:00:00' AS day, 3.0D AS code",
                   "timestamp'2024-05-01 00:00:00' AS day, 3.5D AS code"):
        with pytest.raises(PySparkException, match="would lose"):
            conform(spark.sql(f"SELECT {change}"), schema).collect()


def test_catalog_tables_with_namespace(spark, tables):
    spark.range(3).withColumn("nombre", F.lit("x")).withColumn("documento", F.lit("d")) \
        .createOrReplaceTempView("gn_usuarios")
    assert load_tables(spark, names=["gn_usuarios"])["gn_usuarios"].count() == 3
    spark.catalog.dropTempView("gn_usuarios")
    spark.sql("CREATE DATABASE IF NOT EXISTS clinic")
    try:
        tables["gn_usuarios"].write.mode("overwrite").saveAsTable("clinic.gn_usuarios")
        loaded = load_tables(spark, names=["gn_usuarios"], namespace="clinic")["gn_usuarios"]
        assert sorted(loaded.collect()) == sorted(tables["gn_usuarios"].collect())
    finally:
        spark.sql("DROP DATABASE clinic CASCADE")


def test_a_folder_beside_a_file_of_one_name_is_refused(spark, tables, tmp_path):
    for name in ("gn_usuarios", "gn_usuarios.parquet"):
        tables["gn_usuarios"].write.parquet(str(tmp_path / name))
    with pytest.raises(ValueError, match="2 times"):
        load_tables(spark, str(tmp_path), ["gn_usuarios"])


def test_a_database_table_needs_partitions_or_consent(spark):
    with pytest.raises(ValueError, match="single_task"):
        load_tables(spark, {"url": "jdbc:none"}, ["gn_usuarios"])


def test_a_users_own_session_gets_the_settings(spark):
    own = configure(spark.newSession())
    assert all(own.conf.get(key) == value for key, value in SETTINGS.items())


def test_single_files_and_other_formats(spark, tables, tmp_path):
    users = tables["gn_usuarios"]
    users.write.json(str(tmp_path / "gn_usuarios"))
    loaded = load_tables(spark, str(tmp_path), ["gn_usuarios"], fmt="json")["gn_usuarios"]
    assert sorted(loaded.collect()) == sorted(users.collect())


def test_star_schema_tables_conform(spark):
    for name, table in domain_tables(spark, DATA, table_names()).items():
        assert table.columns == registry()[name].names
