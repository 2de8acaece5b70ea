"""Amounts and dates as functions, with the cases that they have to meet."""

from datetime import date, datetime

from pyspark.sql import functions as F

from predio.functions import espacio, fechas, montos


def valores(spark, filas, esquema, f):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(filas)], "i int, " + esquema)
    return [r.y for r in df.select("i", f.alias("y")).orderBy("i").collect()]


def test_amounts(spark):
    assert valores(spark, [("2,5",), ("3,5",), ("$ 1.250",), ("-2,5",), ("nada",), (None,)], "x string", montos.entero(F.col("x"))) == [2, 4, 1250, -2, None, None]
    casos = [("20%", 9990000.0), ("20%", None), ("0%", 5.0), ("1.998.000", None), ("0", 5.0), (None, 5.0), ("12,5 %", 100.0), ("2,5%", 100.0), ("%", 5.0)]
    assert valores(spark, casos, "x string, p double", montos.pie(F.col("x"), F.col("p"))) == [1998000.0, None, None, 1998000.0, None, None, 12.0, 2.0, None]
    casos = [(5002.125,), (5000.0,), (None,), (float("nan"),), (float("inf"),), (-0.5,), (0.0,), (1e15,), (1.5e-5,), (123456789.25,)]
    assert valores(spark, casos, "x double", montos.para_planilla(F.col("x"))) == ["5002,125", "5000", "", "", "", "-0,5", "0", "1000000000000000", "0,000015", "123456789,25"]
    casos = [(1250.0, "UF"), (1250.5, "UF"), (1234.5678, "UF"), (9990000.5, "CLP"), (999.4, "CLP"), (None, "UF")]
    assert valores(spark, casos, "p double, m string", montos.precio_escrito(F.col("p"), F.col("m"))) == ["UF 1.250", "UF 1.250,5", "UF 1.234,568", "$9.990.001", "$999", None]
    casos = [(9990000.0, "CLP", 1998000.0, 24, 333000.0), (None, "UF", 10.0, None, None), (5.0, "CLP", None, 12, None), (5.0, "CLP", 0.0, 0, 1.0)]
    got = valores(spark, casos, "p double, m string, a double, c int, v double", montos.financiamiento(*map(F.col, "pmacv")))
    assert [[tuple(f) for f in g] for g in got] == [[("Pie desde", "$1.998.000 (20%)"), ("Cuotas", "24 cuotas de $333.000")], [("Pie desde", "UF 10")], [("Cuotas", "12 cuotas")], []]


def test_dates(spark):
    ntz = "a timestamp_ntz, b timestamp_ntz, c timestamp_ntz"
    t = lambda h, m=0, d=1: datetime(2026, 10, d, h, m)
    filas = [(t(10), t(12), t(11)), (t(10), t(12), t(13)), (t(10), t(10), t(9)), (t(10), t(12), t(9))]
    assert valores(spark, filas, ntz, fechas.parte_restante(*map(F.col, "abc"))) == [0.5, 0.0, None, 1.0]
    assert valores(spark, filas, ntz, fechas.minutos_restantes(F.col("b"), F.col("c"))) == [60, 0, 60, 180]
    filas = [(t(10), t(10)), (t(10), t(10, 59)), (t(10), t(11)), (t(10), t(9, 59, 2)), (t(10), t(10, 0, 4))]
    assert valores(spark, filas, "a timestamp_ntz, b timestamp_ntz", fechas.hace(F.col("a"), F.col("b"))) == ["recién", "hace 59 min", "hace 1 h", "hace 23 h", "hace 3 días"]
    dias = [(date(2026, 10, 1),), (date(2026, 9, 30),), (date(2026, 9, 29),), (None,)]
    assert valores(spark, dias, "d date", fechas.nombre_del_dia(F.col("d"), F.lit("2026-10-01").cast("date"))) == ["Hoy", "Ayer", "martes", None]
    assert valores(spark, dias, "d date", fechas.fecha_legible(F.col("d"))) == ["1 de octubre de 2026", "30 de septiembre de 2026", "29 de septiembre de 2026", None]
    assert valores(spark, [(0,), (3661,), (36_000,)], "s int", fechas.duracion(F.col("s"))) == ["0:00:00", "1:01:01", "10:00:00"]
    utc = [(datetime(2026, 7, 1, 3, 59),), (datetime(2026, 7, 1, 4, 0),), (datetime(2026, 1, 1, 2, 59),), (datetime(2026, 1, 1, 3, 0),)]
    assert valores(spark, utc, "x timestamp_ntz", fechas.dia_local(F.col("x"))) == [date(2026, 6, 30), date(2026, 7, 1), date(2025, 12, 31), date(2026, 1, 1)]
    assert valores(spark, [(date(2026, 7, 1),), (date(2026, 1, 1),)], "d date", fechas.medianoche_utc(F.col("d"))) == [datetime(2026, 7, 1, 4), datetime(2026, 1, 1, 3)]


def test_distance(spark):
    casos = [(-72.0, -34.79, -72.0, -34.79), (-72.0, -34.0, -72.0, -34.001), (0.0, 60.0, 0.001, 60.0)]
    got = valores(spark, casos, "a double, b double, c double, d double", F.round(espacio.distancia(*map(F.col, "abcd")), 3))
    assert got == [0.0, 111.32, 55.66]
