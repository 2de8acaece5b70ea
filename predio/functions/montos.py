"""Amounts as numbers and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from predio.functions.texto import monto


def miles(x: Column) -> Column:
    """A whole number with dots between its thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def numero_es(x: Column) -> Column:
    """A number with dots between thousands and at most three decimals after a comma, none if they are zero."""
    con = F.regexp_replace(F.regexp_replace(F.format_number(F.round(x, 3), 3), "0+$", ""), "[.]$", "")
    return F.translate(con, ",.", ".,")


def entero(x: Column) -> Column:
    """A written amount rounded to a whole number, halves to the even one."""
    return F.bround(monto(x), 0).cast("long")


def pie(x: Column, precio: Column) -> Column:
    """Down payment as an amount: of a percentage that of the price (null without one), halves to even; nothing for zero."""
    parte = monto(F.replace(x, F.lit("%"), F.lit("")))
    de_precio = F.when((parte != 0) & (precio != 0), F.bround(precio * parte / 100, 0))
    return F.when(x.contains("%"), de_precio).otherwise(F.nullif(monto(x), F.lit(0.0)))


def para_planilla(x: Column) -> Column:
    """A number for a sheet: no dots for thousands, a comma for decimals, bare if it is whole; empty if there is none."""
    raro = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    entera = F.format_string("%.0f", x)
    corta = F.when(x.cast("string").contains("E"), F.regexp_replace(F.format_string("%.12f", x), "0+$", "")).otherwise(x.cast("string"))
    return F.when(raro, "").when(x == F.floor(x), F.when(x == 0, "0").otherwise(entera)).otherwise(F.replace(corta, F.lit("."), F.lit(",")))


def precio_escrito(precio: Column, moneda: Column) -> Column:
    """A price as people read it: UF with its decimals, pesos whole (halves up)."""
    return F.when(moneda == "UF", F.concat(F.lit("UF "), numero_es(precio))).otherwise(F.concat(F.lit("$"), miles(F.floor(precio + 0.5))))


def financiamiento(precio: Column, moneda: Column, abono: Column, cuotas: Column, valor_cuota: Column) -> Column:
    """Lines (rotulo, valor) below a price: the down payment with its share of the price, the instalments with their amount."""
    parte = F.when(precio != 0, F.format_string(" (%d%%)", F.floor(abono / precio * 100 + 0.5))).otherwise("")
    fila = lambda rotulo, valor: F.struct(F.lit(rotulo).alias("rotulo"), valor.alias("valor"))
    primera = F.when(abono != 0, fila("Pie desde", F.concat(precio_escrito(abono, moneda), F.coalesce(parte, F.lit("")))))
    valor = F.when(valor_cuota != 0, F.concat(F.lit(" de "), precio_escrito(valor_cuota, moneda)))
    segunda = F.when(cuotas != 0, fila("Cuotas", F.concat(cuotas.cast("string"), F.lit(" cuotas"), F.coalesce(valor, F.lit("")))))
    return F.array_compact(F.array(primera, segunda))
