"""Forms and conditions, case by case."""

from pyspark.sql import functions as F

from predio.functions import validar
from predio.plans import filtros


def test_forms(spark):
    filas = [("Ana", "9 8765 4321", "a@b.cl"), (" A ", "987654321", "a@b.cl"), ("Ana\nB", "123", "a@b.cl"), ("Ana", "+1 437 555 0689", "a@b"), ("Ana", "87654321", ""), (None, None, None), ("Ana", "9" * 16, "a@b.cl")]
    df = spark.createDataFrame([(i, *f) for i, f in enumerate(filas)], "i int, n string, t string, e string")
    c = [F.col(x) for x in "nte"]
    got = [tuple(r.y) for r in df.select("i", validar.comprador(*c).alias("y")).orderBy("i").collect()]
    assert got == [("Ana", "56987654321", "a@b.cl", None), ("A", "56987654321", "a@b.cl", "nombre"), ("Ana B", "123", "a@b.cl", "telefono"), ("Ana", "14375550689", "a@b", "email"), ("Ana", "87654321", "", "email"), ("", "", "", "nombre"), ("Ana", "9" * 16, "a@b.cl", "telefono")]
    leads = [r.m for r in df.select("i", validar.comprador(*c, correo_obligatorio=False)["motivo"].alias("m")).orderBy("i").collect()]
    assert leads == [None, "nombre", "telefono", "email", None, "nombre", "telefono"]


def test_messages_and_numbers(spark):
    df = spark.createDataFrame([(0, " a\r\n\r\n\r\n\r\nb\a\tc \n", "1.200"), (1, None, ""), (2, "x" * 3000, "100001"), (3, "\n\n", " 7 "), (4, "a\rb", "-1"), (5, "", None)], "i int, m string, k string")
    got = [(r.m, r.n, r.mal) for r in df.select("i", validar.mensaje(F.col("m")).alias("m"), validar.cuantas(F.col("k")).alias("k")).select("i", "m", "k.*").orderBy("i").collect()]
    assert got == [("a\n\nbc", 1200, False), ("", None, False), ("x" * 2000, None, True), ("", 7, False), ("a\nb", None, True), ("", None, False)]


def test_conditions_that_are_not_set_hold_for_all(spark):
    df = spark.createDataFrame([(1, "vendido", None, 1, None), (2, "disponible", 10.0, 1, "p1"), (3, "disponible", 40.0, None, "")], "id int, estado string, superficie double, etapa int, mejor_vista string")
    ids = lambda **c: [r.id for r in filtros.filtrar(df, **c).orderBy("id").collect()]
    assert ids() == [1, 2, 3] and ids(minima=1) == [2, 3] and ids(minima=0) == [1, 2, 3] and ids(maxima=20) == [2] and ids(con_vista=True) == [2] and ids(etapa="1") == [1, 2] and ids(estados=("vendido",), etapa=2) == []
