"""Insider transactions: codes, signs, values, and the XML they come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import parse_date, parse_decimal

#: Names of the transaction codes of ownership forms, and which of them count as bought and sold; results show them.
CODES = {
    "A": "Grant/Award",
    "C": "Conversion",
    "F": "Tax Withholding",
    "G": "Gift",
    "J": "Other",
    "K": "Equity Swap",
    "M": "Exercise/Conversion",
    "P": "Purchase",
    "S": "Sale",
    "U": "Disposition to Issuer",
    "W": "Exercise of In-Money",
    "X": "Exercise of Out-of-Money",
}
BUYS, SELLS = ("P", "A", "M", "C", "W", "X"), ("S", "F", "G", "U")


def code_name(code: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in CODES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("Other ("), code, F.lit(")")))


def is_buy(code: Column, sign: Column) -> Column:
    return (sign == "A") & code.isin(*BUYS)


def is_sell(code: Column, sign: Column) -> Column:
    return (sign == "D") | code.isin(*SELLS)


def signed(shares: Column, sign: Column) -> Column:
    return F.when(sign == "A", shares).otherwise(-shares)


def role(title: Column, officer: Column, director: Column, owner: Column, other: Column | None = None) -> Column:
    """Title or Officer, Director, 10% Owner, Other; Unknown if none."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.when(officer, F.lit("Officer")))
    parts = F.concat_ws(", ", named, F.when(director, F.lit("Director")), F.when(owner, F.lit("10% Owner")), F.when(F.lit(False) if other is None else other, F.lit("Other")))
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit("Unknown"))


def chosen(transactions: DataFrame, kind: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Transactions of a kind (buy, sell or a code) between two days, both included."""
    out, code, sign = transactions, F.col("code"), F.col("sign")
    if kind in ("buy", "purchase"):
        out = out.where(is_buy(code, sign))
    elif kind in ("sell", "sale"):
        out = out.where(is_sell(code, sign))
    elif kind:
        out = out.where(code == kind)
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def clean_xml(text: Column) -> Column:
    """Without declaration and document type, from the root element on."""
    out = F.regexp_replace(F.regexp_replace(text, r"<\?xml[^>]*\?>", ""), r"<!DOCTYPE[^>]*>", "")
    return F.regexp_extract(out, r"(?s)(<ownershipDocument.*)", 1)


_VALUE = "struct<value:string>"
_OWNERSHIP = f"struct<directOrIndirectOwnership:{_VALUE},natureOfOwnership:{_VALUE}>"
_AFTER = f"struct<sharesOwnedFollowingTransaction:{_VALUE}>"
_TRANSACTION = (
    f"struct<securityTitle:{_VALUE},transactionDate:{_VALUE},transactionCoding:struct<transactionCode:string>,conversionOrExercisePrice:{_VALUE},"
    f"transactionAmounts:struct<transactionShares:{_VALUE},transactionPricePerShare:{_VALUE},transactionAcquiredDisposedCode:{_VALUE}>,"
    f"postTransactionAmounts:{_AFTER},ownershipNature:{_OWNERSHIP}>"
)
_HOLDING = f"struct<securityTitle:{_VALUE},postTransactionAmounts:{_AFTER},ownershipNature:{_OWNERSHIP}>"
_OWNER = "struct<reportingOwnerId:struct<rptOwnerName:string,rptOwnerCik:string>,reportingOwnerName:string,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,isOther:string,officerTitle:string>>"
#: What is read of an ownership form.
FORM = (
    "periodOfReport string, reportingOwnerName string, issuer struct<issuerCik:string,issuerName:string,issuerTradingSymbol:string>, "
    f"reportingOwner array<{_OWNER}>, nonDerivativeTable struct<nonDerivativeTransaction:array<{_TRANSACTION}>,nonDerivativeHolding:array<{_HOLDING}>>, derivativeTable struct<derivativeTransaction:array<{_TRANSACTION}>>"
)


def _text(value: Column, default: str | None = None) -> Column:
    """Trimmed text; the default where there is none."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default).cast("string"))


def _decimal(value: Column) -> Column:
    return F.coalesce(parse_decimal(value), F.lit(0).cast("decimal(20,4)"))


def read_form4(forms: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, form): each ownership form parsed once; what can't be parsed is null throughout."""
    return forms.select(id_col, F.from_xml(clean_xml(F.col(xml_col)), FORM, {"rowTag": "ownershipDocument"}).alias("form"))


def _owner() -> Column:
    first = F.try_element_at("form.reportingOwner", F.lit(1))
    return F.coalesce(_text(first["reportingOwnerId"]["rptOwnerName"]), _text(first["reportingOwnerName"]), _text(F.col("form.reportingOwnerName"), ""))


def filings(read: DataFrame, id_col: str) -> DataFrame:
    """(id, period, issuer, issuer_cik, ticker, owner, owner_cik, is_director, is_officer, is_ten_percent_owner, is_other, title, role): the first reporting owner; flags are true where they say 1."""
    first = F.try_element_at("form.reportingOwner", F.lit(1))
    relation = first["reportingOwnerRelationship"]
    flag = lambda name: F.coalesce(F.trim(relation[name]) == "1", F.lit(False)).alias(name)
    out = read.select(
        id_col,
        parse_date(F.trim("form.periodOfReport")).alias("period"),
        _text(F.col("form.issuer.issuerName"), "").alias("issuer"),
        _text(F.col("form.issuer.issuerCik"), "").alias("issuer_cik"),
        _text(F.col("form.issuer.issuerTradingSymbol"), "").alias("ticker"),
        _owner().alias("owner"),
        _text(first["reportingOwnerId"]["rptOwnerCik"], "").alias("owner_cik"),
        *map(flag, ("isDirector", "isOfficer", "isTenPercentOwner", "isOther")),
        _text(relation["officerTitle"], "").alias("title"),
    )
    out = out.withColumnsRenamed({"isDirector": "is_director", "isOfficer": "is_officer", "isTenPercentOwner": "is_ten_percent_owner", "isOther": "is_other"})
    return out.withColumn("role", role(F.col("title"), F.col("is_officer"), F.col("is_director"), F.col("is_ten_percent_owner"), F.col("is_other")))


def transactions(read: DataFrame, id_col: str, *more: str) -> DataFrame:
    """(id, derivative, nth, security, date, code, shares, price, sign, owned_after, ownership) of transactions with a date, and ``more`` columns of ``read``.

    Shares default to 0, the sign to A, ownership to D. A derivative's missing price
    is its conversion or exercise price, and its ownership counts as direct. Both
    kinds come out of one pass, so each form is parsed once.
    """
    each = lambda path, derivative: F.transform(F.coalesce(path, F.array().cast(f"array<{_TRANSACTION}>")), lambda t, i: F.struct(F.lit(derivative).alias("derivative"), i.alias("nth"), t.alias("t")))
    listed = F.concat(each("form.nonDerivativeTable.nonDerivativeTransaction", False), each("form.derivativeTable.derivativeTransaction", True))
    both = read.select(id_col, *more, F.inline(listed))
    amounts, derivative = F.col("t.transactionAmounts"), F.col("derivative")
    price = parse_decimal(amounts["transactionPricePerShare"]["value"])
    return both.select(
        id_col,
        *more,
        "derivative",
        "nth",
        _text(F.col("t.securityTitle.value"), "").alias("security"),
        parse_date(F.trim("t.transactionDate.value")).alias("date"),
        _text(F.col("t.transactionCoding.transactionCode"), "").alias("code"),
        _decimal(amounts["transactionShares"]["value"]).alias("shares"),
        F.when(derivative, F.coalesce(price, parse_decimal(F.col("t.conversionOrExercisePrice.value")))).otherwise(price).alias("price"),
        _text(amounts["transactionAcquiredDisposedCode"]["value"], "A").alias("sign"),
        F.when(~derivative, parse_decimal(F.col("t.postTransactionAmounts.sharesOwnedFollowingTransaction.value"))).alias("owned_after"),
        F.when(derivative, "D").otherwise(_text(F.col("t.ownershipNature.directOrIndirectOwnership.value"), "D")).alias("ownership"),
    ).where("date IS NOT NULL")


def holdings(read: DataFrame, id_col: str) -> DataFrame:
    """(id, nth, security, shares, ownership, nature) of holdings without a transaction; shares default to 0, ownership to D, its nature to nothing."""
    each = read.select(id_col, F.posexplode("form.nonDerivativeTable.nonDerivativeHolding").alias("nth", "h"))
    return each.select(
        id_col,
        "nth",
        _text(F.col("h.securityTitle.value"), "").alias("security"),
        _decimal(F.col("h.postTransactionAmounts.sharesOwnedFollowingTransaction.value")).alias("shares"),
        _text(F.col("h.ownershipNature.directOrIndirectOwnership.value"), "D").alias("ownership"),
        _text(F.col("h.ownershipNature.natureOfOwnership.value"), "").alias("nature"),
    )


def parse_form4(forms: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """``transactions`` of forms with their owner."""
    read = read_form4(forms, id_col, xml_col)
    return transactions(read.withColumn("owner", _owner()), id_col, "owner")
