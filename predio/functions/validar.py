"""What people write in forms, cleaned, and why it is refused.

Each function returns a struct of the cleaned fields with `motivo`: the name of the first field that
can't be accepted, or null. Callers split accepted and refused rows by it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from predio.functions.texto import es_correo, limpio

#: Longest name and address, longest message, digits of a telephone number, most lots.
NOMBRE, CORREO, MENSAJE, DIGITOS, LOTES = 120, 160, 2000, (8, 15), 100_000


def _texto(x: Column, largo: int) -> Column:
    return limpio(F.coalesce(x.cast("string"), F.lit("")), largo)


def telefono(x: Column) -> Column:
    """Digits only; a mobile number without the country's 56 gets it; as many as there are."""
    d = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[^0-9]", "")
    return F.when(d.rlike("^9[0-9]{8}$"), F.concat(F.lit("56"), d)).otherwise(d)


def _bien(tel: Column) -> Column:
    return F.length(tel).between(*DIGITOS)


def _motivo(*faltas: tuple[str, Column]) -> Column:
    return F.coalesce(*[F.when(mal, campo) for campo, mal in faltas])


def comprador(nombre: Column, tel: Column, email: Column, correo_obligatorio: bool = True) -> Column:
    """nombre, telefono and email of a buyer who asks for a hold; of a lead (correo_obligatorio=False) the address may be missing."""
    n, t, e = _texto(nombre, NOMBRE), telefono(tel), _texto(email, CORREO)
    mal_correo = ~es_correo(e) if correo_obligatorio else (e != "") & ~es_correo(e)
    motivo = _motivo(("nombre", F.length(n) < 2), ("telefono", ~_bien(t)), ("email", mal_correo))
    return F.struct(n.alias("nombre"), t.alias("telefono"), e.alias("email"), motivo.alias("motivo"))


def mensaje(x: Column, largo: int = MENSAJE) -> Column:
    """A message with its paragraphs: no control characters but line ends, at most one empty line between paragraphs."""
    lineas = F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "\r\n?", "\n")
    sin = F.regexp_replace(lineas, r"[\x00-\x09\x0B-\x1F\x7F]", "")
    junto = F.regexp_replace(F.regexp_replace(sin, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    return F.substring(junto, 1, largo)


def cuantas(x: Column, tope: int = LOTES) -> Column:
    """A written number of lots, dots for thousands left out: struct of n and mal (it is there, but none from 1 to `tope`)."""
    t = F.replace(F.trim(F.coalesce(x.cast("string"), F.lit(""))), F.lit("."), F.lit(""))
    v = F.when(t.rlike("^[0-9]{1,9}$"), t.try_cast("int"))
    n = F.when(v.between(1, tope), v)
    return F.struct(n.alias("n"), ((t != "") & n.isNull()).alias("mal"))


def contacto(nombre: Column, email: Column, tel: Column, plan: Column, parcelas: Column, texto: Column, planes: tuple[str, ...], otro: str = "no-se") -> Column:
    """Who asks for an offer: name and address are needed; a telephone number or a number of lots must be one if it is there."""
    n, e, t, k = _texto(nombre, NOMBRE), _texto(email, CORREO), telefono(tel), cuantas(parcelas)
    motivo = _motivo(("nombre", F.length(n) < 2), ("email", ~es_correo(e)), ("telefono", (t != "") & ~_bien(t)), ("parcelas", k["mal"]))
    elegido = F.when(plan.isin(*planes), plan).otherwise(otro)
    return F.struct(n.alias("nombre"), e.alias("email"), t.alias("telefono"), elegido.alias("plan"), k["n"].alias("parcelas"), mensaje(texto).alias("mensaje"), motivo.alias("motivo"))
