import json

from pyspark.sql import functions as F

from hirelake.operators import foreign_keys, validate
from hirelake.spec import DEPARTMENTS, HIRES, table_spec


def run(spark, table, records):
    raw = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)]
    df = spark.createDataFrame(raw, "indice bigint, raw string")
    v = validate.validate_json(df, "raw", table_spec(table))
    errs = {(r.indice, r.campo): r.regla for r in validate.error_rows(v, table, "modelo").collect()}
    valid = {r.indice: r for r in validate.valid_rows(v, table_spec(table), ("indice",)).collect()}
    return errs, valid


def test_department_id_rules(spark):
    recs = [{"id": 1, "departamento": "a"}, {"id": "7", "departamento": "a"},
            {"id": 5.0, "departamento": "a"}, {"id": 5.5, "departamento": "a"},
            {"id": -1, "departamento": "a"}, {"id": 0, "departamento": "a"},
            {"id": 2147483648, "departamento": "a"}, {"id": "abc", "departamento": "a"},
            {"departamento": "a"}, {"id": None, "departamento": "a"}, {"id": True, "departamento": "a"},
            {"id": "5.0", "departamento": "a"}, {"id": "", "departamento": "a"}]
    errs, valid = run(spark, DEPARTMENTS, recs)
    assert set(valid) == {0, 1, 2}
    assert valid[1].id == 7 and valid[2].id == 5
    assert errs[(3, "id")] == "int_from_float"
    assert errs[(4, "id")] == "greater_than"
    assert errs[(5, "id")] == "greater_than"
    assert errs[(6, "id")] == "int_parsing"
    assert errs[(7, "id")] == "int_parsing"
    assert errs[(8, "id")] == "missing"
    assert errs[(9, "id")] == "missing"
    assert errs[(10, "id")] == "int_type"        # documented: booleans are not ids
    assert errs[(11, "id")] == "int_parsing"
    assert errs[(12, "id")] == "int_parsing"


def test_department_name_rules(spark):
    recs = [{"id": 1, "departamento": "ñ" * 50}, {"id": 2, "departamento": "ñ" * 51},
            {"id": 3, "departamento": ""}, {"id": 4, "departamento": "   "},
            {"id": 5, "departamento": 5}, {"id": 6}, {"id": 7, "departamento": "x", "extra": 1}]
    errs, valid = run(spark, DEPARTMENTS, recs)
    assert set(valid) == {0, 3, 6}          # whitespace-only passes, extra keys ignored
    assert errs[(1, "departamento")] == "string_too_long"
    assert errs[(2, "departamento")] == "string_too_short"
    assert errs[(4, "departamento")] == "string_type"
    assert errs[(5, "departamento")] == "missing"


def test_record_not_an_object_and_all_errors_reported(spark):
    errs, valid = run(spark, DEPARTMENTS, ["5", "[1]", "not json", {"id": -1, "departamento": ""}])
    assert not valid
    assert errs[(0, "__root__")] == "not_an_object"
    assert errs[(1, "__root__")] == "not_an_object"
    assert errs[(2, "__root__")] == "not_an_object"
    assert errs[(3, "id")] == "greater_than" and errs[(3, "departamento")] == "string_too_short"


def test_employee_optional_fields(spark):
    recs = [{"id": 501, "fecha_hora": "2020-01-01T00:00:00", "id_departamento": 16, "id_trabajo": 999},
            {"id": 2, "nombre": ""}, {"id": 3, "nombre": None, "id_departamento": None},
            {"id": 4, "id_departamento": 0}, {"id": 5, "fecha_hora": "2021-07-27T16:02:08Z"},
            {"id": 6, "fecha_hora": "x"}, {"id": 7, "nombre": "a" * 101}, {"id": 8, "fecha_hora": 12}]
    errs, valid = run(spark, HIRES, recs)
    assert set(valid) == {0, 1, 2}
    assert valid[1].nombre == ""
    assert errs[(3, "id_departamento")] == "greater_than"
    assert errs[(4, "fecha_hora")] == "datetime_parsing"
    assert errs[(5, "fecha_hora")] == "datetime_parsing"
    assert errs[(6, "nombre")] == "string_too_long"
    assert errs[(7, "fecha_hora")] == "datetime_type"


def test_fk_check_one_error_per_violation(spark):
    rows = spark.createDataFrame(
        [(1, 10, 100), (2, 99, 100), (3, 99, 999), (4, None, None), (5, 10, None)],
        "id int, id_departamento int, id_trabajo int")
    dims = {"departamentos": spark.createDataFrame([(10,), (10,)], "id int"),
            "trabajos": spark.createDataFrame([(100,)], "id int")}
    out = foreign_keys.check_foreign_keys(rows, table_spec(HIRES), dims)
    got = {r.id: sorted(e.campo for e in r.fk_errs) for r in out.collect()}
    assert got == {1: [], 2: ["id_departamento"], 3: ["id_departamento", "id_trabajo"], 4: [], 5: []}
    assert out.count() == 5  # duplicate dimension keys do not duplicate rows


def test_validation_counts_add_up(spark):
    recs = [{"id": i, "departamento": "x" * (i % 60)} for i in range(-3, 80)]
    raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(recs)], "indice bigint, raw string")
    v = validate.validate_json(raw, "raw", table_spec(DEPARTMENTS))
    s = validate.summary_counts(v, DEPARTMENTS).first()
    n_bad = validate.error_rows(v, DEPARTMENTS, "modelo").select("indice").distinct().count()
    assert s.recibidos == len(recs) and s.validos + n_bad == s.recibidos
    assert v.where(F.size("errs") == 0).count() == s.validos
