"""Statements in XBRL, read as XML: facts with their contexts, units, signs and dimensions, one statement of each filing, and why a filing has none.

Prefixes, comments and CDATA do not matter: Spark's reader takes each instance as a
variant, by local names. A context's own dates can be wrong; where the filing states the
period of a context as a fact, that is what counts for durations. Dates of instants stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: fixed values: local names of elements (lower case) and the fields that they are
ELEMENTS = {
    "revenuefromoperations": "revenue",
    "revenuefromoperationsnet": "revenue",
    "netsalesorrevenuefromoperations": "revenue",
    "otherincome": "other_income",
    "totalincome": "total_income",
    "incomeexpenses": "total_income",
    "income": "total_income",
    "totalexpenses": "total_expenses",
    "expenses": "total_expenses",
    "financecosts": "interest_expense",
    "depreciationdepletionandamortisationexpense": "depreciation",
    "profitbeforetax": "profit_before_tax",
    "profitlossbeforetax": "profit_before_tax",
    "taxexpense": "tax_expense",
    "totaltaxexpense": "tax_expense",
    "profitlossforperiod": "profit_for_period",
    "profitlossfortheperiod": "profit_for_period",
    "netprofitlossfortheperiod": "profit_for_period",
    "profitorlossattributabletoownersofparent": "pat",
    "profitorlossattributabletononcontrollinginterests": "non_controlling_interest",
    "basicearningspershare": "eps_basic",
    "basicearningslosspershare": "eps_basic",
    "basicearningslosspersharefromcontinuinganddiscontinuedoperations": "eps_basic",
    "dilutedearningspershare": "eps_diluted",
    "dilutedearningslosspersharefromcontinuinganddiscontinuedoperations": "eps_diluted",
    "shareofprofitlossofassociatesandjointventuresaccountedforusingequitymethod": "share_of_associates",
    "assets": "total_assets",
    "equity": "total_equity",
    "equityandliabilities": "equity_and_liabilities",
    "borrowingscurrent": "borrowings_current",
    "borrowingsnoncurrent": "borrowings_noncurrent",
    "cashandcashequivalents": "cash",
    "cashflowsfromusedinoperatingactivities": "ocf",
    "purchaseofpropertyplantandequipmentclassifiedasinvestingactivities": "capex",
}
#: fixed values: elements that are no amounts
AUDITED = "whetherresultsareauditedorunaudited"
OPINION = "declarationofunmodifiedopinionorstatementonimpactofauditqualification"
PERIOD_START, PERIOD_END = "dateofstartofreportingperiod", "dateofendofreportingperiod"
PER_SHARE = ("eps_basic", "eps_diluted")
#: days that a year has at least; rupees in a crore
ANNUAL_DAYS, CRORE = 300, 1e7
FIELDS = sorted(set(ELEMENTS.values()))
_XML = {"ignoreNamespace": "true"}


def well_formed(xml: Column) -> Column:
    told = F.from_xml(xml, "_corrupt_record string, _VALUE string", _XML)
    return xml.isNotNull() & told["_corrupt_record"].isNull()


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _many(v: Column, path: str) -> Column:
    """What stands at a path as an array: an element that occurs once is no array there."""
    one = F.try_variant_get(v, path, "variant")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)))


def _day(text: Column) -> Column:
    return F.try_to_timestamp(F.substring(F.trim(text), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def facts(documents: DataFrame) -> DataFrame:
    """doc_id, element, context, text, value, unit, decimals, start, end, instant, dimensional: every fact of well-formed instances that is not nil, with its context.

    documents: doc_id, xml. A duration's start and end are those that the filing states, the
    context's own where it states none. A fact of a context that is not there is left out.
    An instance is one row until its facts are apart, so nothing is shuffled.
    """
    # the guard stands in the expression, where no rule of the optimizer moves it behind the reader, which fails on what is no XML
    read = documents.select("doc_id", F.when(well_formed(F.col("xml")), F.from_xml("xml", "variant", _XML)).alias("v"))
    named = F.map_entries(F.try_variant_get("v", "$", "map<string,variant>"))  # elements by local name
    apart = F.flatten(F.transform(named, lambda e: F.transform(_many(e["value"], "$"), lambda x: F.struct(e["key"].alias("element"), x.alias("x")))))
    read = read.select("doc_id", apart.alias("es"))

    def fact(e: Column) -> Column:
        text, x = _text(e["x"]), e["x"]
        value = F.regexp_replace(text, ",", "").try_cast("double") * F.when(_at(x, "$._sign") == "-", -1).otherwise(1)
        return F.struct(e["element"].alias("element"), _at(x, "$._contextRef").alias("context"), text.alias("text"), value.alias("value"), _at(x, "$._unitRef").alias("unit"), _at(x, "$._decimals").alias("decimals"))

    def context(e: Column) -> Column:
        x = e["x"]
        start, end, instant = (_at(x, f"$.period.{n}") for n in ("startDate", "endDate", "instant"))
        return F.struct(_at(x, "$._id").alias("context"), _day(start).alias("start"), _day(F.coalesce(end, instant)).alias("end"), instant.isNotNull().alias("instant"), F.to_json(x).rlike('"(explicitMember|typedMember)"').alias("dimensional"))

    is_context = lambda e: F.lower(e["element"]) == "context"
    is_fact = lambda e: ~is_context(e) & _at(e["x"], "$._contextRef").isNotNull() & ~F.coalesce(_at(e["x"], "$._nil", "boolean"), F.lit(False)) & (_text(e["x"]) != "")
    read = read.select("doc_id", F.transform(F.filter("es", is_context), context).alias("cs"), F.transform(F.filter("es", is_fact), fact).alias("fs"))
    # the periods that the filing states
    read = read.withColumn("ps", F.filter("fs", lambda f: F.lower(f["element"]).isin(PERIOD_START, PERIOD_END)))

    def dated(c: Column) -> Column:
        own = F.filter("ps", lambda f: f["context"] == c["context"])
        stated = lambda name: F.array_max(F.transform(F.filter(own, lambda f: F.lower(f["element"]) == name), lambda f: _day(f["text"])))
        override = ~c["instant"] & (F.size(own) > 0)
        start = F.when(override, stated(PERIOD_START)).when(~c["instant"], c["start"])
        return F.struct(c["context"].alias("context"), start.alias("start"), F.when(override, stated(PERIOD_END)).otherwise(c["end"]).alias("end"), c["instant"].alias("instant"), c["dimensional"].alias("dimensional"))

    read = read.select("doc_id", F.transform("cs", dated).alias("cs"), "fs")
    told = read.select("doc_id", F.explode("fs").alias("f"), "cs").withColumn("c", F.get(F.filter("cs", lambda c: c["context"] == F.col("f.context")), F.lit(0)))
    return told.where("c IS NOT NULL").select("doc_id", "f.*", "c.start", "c.end", "c.instant", "c.dimensional")


def _text(x: Column) -> Column:
    """An element's text; a comment in it makes parts."""
    return F.trim(F.coalesce(F.array_join(_at(x, "$._VALUE", "array<string>"), ""), _at(x, "$._VALUE")))


def field_of(element: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])
    return names[F.lower(element)]


def unmapped(rows: DataFrame) -> DataFrame:
    """element, n: reported elements without a field."""
    other = (AUDITED, OPINION, PERIOD_START, PERIOD_END)
    return rows.where(field_of(F.col("element")).isNull() & ~F.lower("element").isin(*other)).groupBy("element").agg(F.count("*").alias("n"))


def _chosen(rows: DataFrame, keep: Column, order: list[Column]) -> DataFrame:
    """The context that comes first in ``order`` of each document, among those that ``keep`` holds for."""
    contexts = rows.where(keep & ~F.col("dimensional")).select("doc_id", "context", "start", "end", "instant").distinct()
    first = Window.partitionBy("doc_id").orderBy(*order, "context")
    return contexts.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")


def _values(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """doc_id, field, value, start, end of mapped facts in the contexts; of several elements of a field the last by name counts."""
    met = rows.where("value IS NOT NULL").withColumn("field", field_of(F.col("element"))).where("field IS NOT NULL").join(contexts.select("doc_id", "context"), ["doc_id", "context"])
    return met.groupBy("doc_id", "field").agg(F.max_by("value", F.struct(F.lower("element"), "context")).alias("value"), F.min("start").alias("start"), F.max("end").alias("end"))


def quarter_values(rows: DataFrame) -> DataFrame:
    """doc_id, field, value, start, end: facts of the shortest duration among those that end last, and of the instant of that day."""
    span = F.datediff("end", "start")
    quarter = _chosen(rows, ~F.col("instant") & F.col("end").isNotNull() & F.col("start").isNotNull(), [F.desc("end"), span])
    instants = _chosen(rows.join(quarter.select("doc_id", F.col("end").alias("_end")), "doc_id").where("instant AND end = _end"), F.lit(True), [F.desc("end")])
    return _values(rows, quarter.unionByName(instants))


def annual_statements(documents: DataFrame, rows: DataFrame | None = None, required: tuple[str, ...] = ("revenue", "pat")) -> DataFrame:
    """doc_id, reason (NULL for a statement), period_start, period_end, audited, opinion_note, the fields in crore, total_debt and total_liabilities of every instance.

    Flows are those of the longest duration among the ones that end last, which must have
    ``ANNUAL_DAYS`` days; stocks are those of the last instant. An instance that is not
    well-formed, has no contexts, no such duration, no instant, or lacks a field of
    ``required`` is refused for that reason. rows: ``facts`` of the documents, where they
    are kept already.
    """
    rows = facts(documents) if rows is None else rows
    span = F.datediff("end", "start")
    year = _chosen(rows, ~F.col("instant") & F.col("end").isNotNull(), [F.desc("end"), F.desc_nulls_last(span)])
    instant = _chosen(rows, F.col("instant") & F.col("end").isNotNull(), [F.desc("end")])
    long = _values(rows, year.unionByName(instant)).withColumn("value", F.when(F.col("field").isin(*PER_SHARE), F.col("value")).otherwise(F.col("value") / CRORE))
    wide = long.groupBy("doc_id").pivot("field", FIELDS).agg(F.max("value"))
    element = F.lower("element")
    notes = rows.groupBy("doc_id").agg(F.max(F.when(element == AUDITED, F.lower("text").startswith("audited"))).alias("audited"), F.min(F.when(element == OPINION, F.col("text"))).alias("opinion_note"))
    judged = documents.select("doc_id", well_formed(F.col("xml")).alias("_ok"))
    judged = judged.join(notes, "doc_id", "left").join(year.select("doc_id", F.col("start").alias("period_start"), F.col("end").alias("_end"), span.alias("_days")), "doc_id", "left")
    judged = judged.join(instant.select("doc_id", F.col("end").alias("period_end")), "doc_id", "left").join(wide, "doc_id", "left").withColumn("pat", F.coalesce("pat", "profit_for_period"))
    debt = F.when(F.col("borrowings_current").isNotNull() | F.col("borrowings_noncurrent").isNotNull(), F.coalesce("borrowings_current", F.lit(0.0)) + F.coalesce("borrowings_noncurrent", F.lit(0.0)))
    judged = judged.withColumn("total_debt", debt).withColumn("total_liabilities", F.col("equity_and_liabilities") - F.col("total_equity"))
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in required)))
    days = F.col("_days")
    reason = (
        F.when(~F.col("_ok"), "not well-formed XML")
        .when(F.col("_end").isNull() & F.col("period_end").isNull(), "no XBRL contexts")
        .when(F.col("_end").isNull(), "no duration context")
        .when(days.isNull() | (days < ANNUAL_DAYS), F.concat(F.lit("longest period ending "), F.col("_end").cast("string"), F.lit(" spans "), F.coalesce(days, F.lit(0)).cast("string"), F.lit(f" days, short of {ANNUAL_DAYS}")))
        .when(F.col("period_end").isNull(), "no instant context")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    )
    return judged.withColumn("reason", reason).drop("_ok", "_end", "_days")


def pending_annual(refs: DataFrame, stored: DataFrame, refused: DataFrame) -> DataFrame:
    """Filings to read: one of each company-year, neither stored (isin, fiscal_year, basis) nor refused before (the same keys).

    refs: isin, fiscal_year, is_consolidated, period_end, broadcast_date. A filing whose
    basis is not known counts as standalone; a company that files consolidated statements
    is taken by those alone. Of several the first broadcast counts; without a broadcast
    date, 60 days after the period.
    """
    group = F.coalesce("is_consolidated", F.lit(False))
    rows = refs.withColumn("basis", F.when(group, "CONSOLIDATED").otherwise("STANDALONE")).withColumn("broadcast_date", F.coalesce("broadcast_date", F.date_add("period_end", 60)))
    rows = rows.withColumn("_any", F.bool_or(group).over(Window.partitionBy("isin"))).where(group == F.col("_any")).drop("_any")
    one = Window.partitionBy("isin", "fiscal_year").orderBy("period_end", "broadcast_date")
    rows = rows.withColumn("_r", F.row_number().over(one)).where("_r = 1").drop("_r")
    keys = ["isin", "fiscal_year", "basis"]
    return rows.join(stored.select(*keys), keys, "left_anti").join(refused.select(*keys), keys, "left_anti")
