"""Formal employment: monthly movements (flows) and the yearly stock.  A stock is never derived from flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import strict_number
from ..functions.text import pad_code
from ..operators import aggregates, disclosure, joins, mapping, quality, windows
from ..sources.delimited import Layout, file_facts, read_contract, read_edition

# fixed values: columns of the movement files (late files have those of on-time files)
_COMMON = (
    "competenciamov regiao uf municipio secao subclasse saldomovimentacao cbo2002ocupacao categoria graudeinstrucao idade "
    "horascontratuais racacor sexo tipoempregador tipoestabelecimento tipomovimentacao tipodedeficiencia indtrabintermitente "
    "indtrabparcial salario tamestabjan indicadoraprendiz origemdainformacao competenciadec"
).split()
_ON_TIME = "indicadordeforadoprazo unidadesalariocodigo valorsalariofixo".split()
_EXCLUSION = "competenciaexc indicadordeexclusao".split()
LAYOUTS = {
    "MOV": Layout((*_COMMON, *_ON_TIME)),
    "FOR": Layout((*_COMMON, *_ON_TIME)),
    "EXC": Layout((*_COMMON, *_EXCLUSION, *_ON_TIME)),
}
# fixed values: columns of the stock microdata of 2025, as published
_STOCK_2025 = (
    "Bairros SP - Código", "Bairros Fortaleza - Código", "Bairros RJ - Código", "Causa Afastamento 1 - Código", "Causa Afastamento 2 - Código",
    "Causa Afastamento 3 - Código", "Motivo Desligamento - Código", "CBO 2002 Ocupação - Código", "CNAE 2.0 Classe - Código",
    "CNAE 95 Classe - Código", "Distritos SP - Código", "Ind Vínculo Ativo 31/12 - Código", "Faixa Etária - Código",
    "Faixa Rem Média (SM) - Código", "Faixa Hora Contrat - Código", "Faixa Rem Dez (SM) - Código", "Faixa Tempo Emprego - Código",
    "Escolaridade Após 2005 - Código", "Qtd Hora Contr", "Idade", "Ind CEI Vinculado - Código",
    "Ind Estabelecimento Participante SIMPLES - Código", "Mês Admissão - Código", "Mês Desligamento - Código", "Município Trab - Código",
    "Município - Código", "Nacionalidade - Código", "Natureza Jurídica - Código", "Ind Portador Defic - Código", "Qtd Dias Afastamento",
    "Raça Cor - Código", "Região Adm DF - Código", "Vl Rem Dezembro Nom", "Vl Rem Dezembro (SM)", "Vl Rem Média Nom", "Vl Rem Média (SM)",
    "CNAE 2.0 Subclasse - Codigo", "Sexo - Código", "Tamanho Estabelecimento - Código", "Tempo Emprego",
    "Tipo Admissão Trabalhador - Código", "Tipo Estabelecimento - Código", "Tipo Estabelecimento - Nome", "Tipo Deficiência - Código",
    "Tipo Vínculo - Código", "IBGE Subsetor - Código", "Vl Rem Janeiro SC", "Vl Rem Fevereiro SC", "Vl Rem Março SC", "Vl Rem Abril SC",
    "Vl Rem Maio SC", "Vl Rem Junho SC", "Vl Rem Julho SC", "Vl Rem Agosto SC", "Vl Rem Setembro SC", "Vl Rem Outubro SC",
    "Vl Rem Novembro SC", "Ano Chegada Brasil", "Ind Trabalho Intermitente - Código", "Ind Trabalho Parcial - Código",
    "Ind Vínculo Abandonado - Código", "Categoria Trabalhador - Código",
)
STOCK_LAYOUTS = {"2025": Layout(_STOCK_2025, sep=",", encoding="cp1252")}
_STOCK_FIELDS = {
    "source_code": "municipiocodigo", "active": "indvinculoativo3112codigo", "abandoned": "indvinculoabandonadocodigo",
    "wage": "vlremdezembronom", "class": "cnae20classecodigo",
}
# fixed values: movement types of each sign
ADMISSIONS = ("10", "20", "25", "35", "70", "97")
DISMISSALS = ("31", "32", "33", "40", "43", "45", "50", "60", "80", "90", "98")
# fixed values: sector of an activity section, and of a two-digit division
SECTION_SECTOR = {
    "A": "agriculture", "B": "industry", "C": "industry", "D": "industry", "E": "industry", "F": "construction", "G": "commerce",
    **{s: "services" for s in "HIJKLMNOPQRSTU"},
}
DIVISION_SECTOR = ((1, 3, "agriculture"), (5, 39, "industry"), (41, 43, "construction"), (45, 47, "commerce"), (49, 99, "services"))
SECTORS = ("agriculture", "industry", "construction", "commerce", "services")
MEASURES = ("admissions", "dismissals", "balance")


def read_movements(spark: SparkSession, paths: Mapping[str, str], file_pattern: str = r"(\d{6})\.[A-Za-z]+$") -> DataFrame:
    """Movement files by kind; the publication month comes from the file name."""
    used = [
        "competenciamov", "competenciadec", "uf", "municipio", "secao", "subclasse", "saldomovimentacao", "cbo2002ocupacao",
        "tipomovimentacao", "salario", "indtrabintermitente", "indicadordeforadoprazo",
    ]
    out = None
    for kind, path in paths.items():
        select = [*used, *_EXCLUSION] if kind == "EXC" else used
        rows = read_contract(spark, path, LAYOUTS[kind], select, with_path=True)
        rows = file_facts(rows, file_pattern, ["publication"], "file_path").drop("file_path").withColumn("kind", F.lit(kind))
        for c in _EXCLUSION:
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast("string"))
        out = rows if out is None else out.unionByName(rows)
    return out


def movements(
    raw: DataFrame, activities: DataFrame, occupations: DataFrame, minimum: DataFrame,
) -> DataFrame:
    """Typed movements with the reason a record is refused (``problem``), for any territory set.

    ``activities`` and ``occupations`` are ``code, label`` dictionaries; ``minimum`` is ``year, minimum``.
    """
    sign, typ = F.col("saldomovimentacao").try_cast("int"), F.lpad("tipomovimentacao", 2, "0")
    wage = strict_number(F.col("salario"), comma=True, type_="decimal(18,2)")
    typed = raw.select(
        F.col("municipio").alias("source_code"), F.col("uf").alias("state_code"), "kind", "publication", F.col("competenciamov").alias("month"),
        F.substring("competenciamov", 1, 4).alias("year"), sign.alias("sign"), F.when(F.col("kind") == "EXC", -1).otherwise(1).alias("weight"),
        mapping.classify(F.col("secao"), SECTION_SECTOR).alias("sector"), F.coalesce(pad_code(F.col("subclasse"), 7), "subclasse").alias("activity"),
        F.coalesce(pad_code(F.col("cbo2002ocupacao"), 6), "cbo2002ocupacao").alias("occupation"), wage.alias("salary"),
        (F.col("indtrabintermitente") != "0").alias("intermittent"),
        mapping.movement_problem(
            F.col("kind"), F.col("competenciamov"), F.col("competenciadec"), F.col("competenciaexc"), F.col("indicadordeforadoprazo"),
            F.col("indicadordeexclusao"), sign, typ, F.col("publication"), ADMISSIONS, DISMISSALS).alias("problem"),
    )
    known = joins.lookup(joins.lookup(typed, activities, "activity", 7, "activity_label"), occupations, "occupation", 6, "occupation_label")
    eligible = mapping.wage_eligible(known, minimum, "year", F.col("salary"), F.col("sign") == 1, F.col("intermittent"))
    return eligible.withColumn("problem", F.coalesce(
        "problem", F.when(F.col("sector").isNull(), "unknown section"), "activity_problem", "occupation_problem",
    )).drop("activity_problem", "occupation_problem", "intermittent")


def additive_ledger(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Movements reduced to figures that add up, so that several ledgers over parts of ``keys`` need one pass over them."""
    n, total = aggregates.sample_sums(F.col("salary"), F.col("weight"), F.col("wage_eligible"))
    return rows.groupBy(*keys).agg(*aggregates.flow_counts(), n.alias("wage_sample"), total.alias("wage_total"))


def _flows(additive: bool) -> list[Column]:
    return [F.sum(m).cast("bigint").alias(m) for m in MEASURES] if additive else aggregates.flow_counts()


def monthly(rows: DataFrame, territories: DataFrame, start: str, latest: str, additive: bool = False) -> DataFrame:
    """Dense months with counts, mean admission wage, year-to-date and 12-month sums.

    The window was read from complete publications, so a month without movements is a zero.  ``rows`` are movements, or
    with ``additive`` those of an :func:`additive_ledger`.
    """
    sums = [F.sum("wage_sample"), F.sum("wage_total")] if additive else aggregates.sample_sums(F.col("salary"), F.col("weight"), F.col("wage_eligible"))
    led = rows.groupBy("territory", "month").agg(*_flows(additive), *aggregates.mean_of_sums(*sums))
    spine = windows.month_spine(territories.select("territory"), start, latest)
    led = led.withColumnsRenamed({"mean": "admission_salary", "sample": "salary_sample"})
    dense = windows.densify(spine, led, ["territory", "month"], MEASURES, F.lit(True), ["admission_salary", "salary_sample"])
    out = windows.complete_trailing(dense, ["territory"], "month", MEASURES)
    return windows.complete_year_to_date(out, ["territory"], "month", MEASURES)


def finalization_problems(rows: DataFrame, axes: Sequence[str] = ("sector", "activity", "occupation")) -> DataFrame:
    """Ledger cells that retractions left negative; legal while accumulating, refused at publication."""
    g = aggregates.breakdowns(rows, ["territory", "month"], list(axes))
    return g.filter((F.col("admissions") < 0) | (F.col("dismissals") < 0))


def sector_series(rows: DataFrame, territories: DataFrame, start: str, latest: str, additive: bool = False) -> DataFrame:
    """Dense months by sector, from movements or (``additive``) from an :func:`additive_ledger`."""
    spine = windows.month_spine(territories.select("territory"), start, latest, categories=SECTORS, category="sector")
    led = rows.groupBy("territory", "month", "sector").agg(*_flows(additive))
    return windows.densify(spine, led, ["territory", "month", "sector"], MEASURES, F.lit(True))


def protected_breakdown(rows: DataFrame, axis: str) -> DataFrame:
    """Occupations or activities with small categories folded into ``other`` or the month withheld."""
    return disclosure.merge_small(aggregates.ledger(rows, ["territory", "month", axis]), ["territory", "month"], axis)


def national(rows: DataFrame, month: str) -> DataFrame:
    """Unfiltered control figures of one month (``rows`` before the territory filter)."""
    return rows.filter(F.col("month") == month).groupBy("month").agg(*aggregates.flow_counts())


def stock_table(bound_cells: DataFrame, group_sector: Mapping[str, str], code_name: str = "Código", state_name: str = "UF") -> DataFrame:
    """Official stock workbook (bound two-row header) to ``source_code, state, year, sector, stock``."""
    who = bound_cells.filter(F.col("name").isin(code_name, state_name)).groupBy("path", "sheet", "row").agg(
        F.max(F.when(F.col("name") == code_name, F.col("text"))).alias("source_code"),
        F.max(F.when(F.col("name") == state_name, F.col("text"))).alias("state"))
    values = bound_cells.filter(F.col("name").rlike(r"^\d{4}$"))
    return values.join(who, ["path", "sheet", "row"]).select(
        "source_code", "state", F.col("name").alias("year"), mapping.classify(F.col("group"), group_sector).alias("sector"),
        F.col("text").try_cast("bigint").alias("stock"))


def read_stock(spark: SparkSession, path: str | Sequence[str], edition: str, layouts: Mapping[str, Layout] = STOCK_LAYOUTS) -> DataFrame:
    """Stock microdata of one edition; an edition without a layout fails before anything is read."""
    raw = read_edition(spark, path, edition, layouts, list(_STOCK_FIELDS.values()))
    return raw.select(*[F.trim(f).alias(n) for n, f in _STOCK_FIELDS.items()], "edition")


def stock_records(raw: DataFrame) -> DataFrame:
    """Typed stock records; ``problem`` names what refuses the edition."""
    flag = lambda c: F.coalesce(F.col(c).isin("0", "1"), F.lit(False))
    division = F.substring(pad_code(F.col("class"), 5), 1, 2).try_cast("int")
    wage = strict_number(F.col("wage"), comma=True, type_="decimal(18,2)")
    return raw.withColumns({"state_code": F.substring("source_code", 1, 2), "division": division, "wage": wage}).withColumn(
        "problem",
        F.when(~flag("active") | ~flag("abandoned"), "invalid flag").when(F.col("wage") < 0, "negative wage")
        .when(mapping.classify_range(F.col("division"), DIVISION_SECTOR).isNull(), "unknown division"))


def stock_disagreements(computed: DataFrame, official: DataFrame) -> DataFrame:
    """Gate: territories and sectors whose stock by records is not the published one, to the unit."""
    both = joins.reconcile(computed.withColumnRenamed("stock", "value"), official.withColumnRenamed("stock", "value"), ["territory", "sector"])
    return quality.violations(both.filter("status <> 'matched'"), "stock", ["territory", "sector"], F.concat_ws(" ", "status", "computed", "official"))


def stock_shares(stock: DataFrame) -> DataFrame:
    """Sector share of the published total, with whether the sectors add up to it."""
    keys = ["territory", "year"]
    value = stock.withColumnRenamed("stock", "value")
    return aggregates.distribution(value.filter("sector <> 'total'"), value.filter("sector = 'total'"), keys)


def stock_remuneration(records: DataFrame, active: str, abandoned: str, division: Column, wage: Column) -> DataFrame:
    """Stock, sample and mean December wage per sector and in total, from stock records."""
    kept = records.filter(mapping.active_stock(F.col(active), F.col(abandoned))).select(
        "territory", mapping.classify_range(division, DIVISION_SECTOR).alias("sector"), wage.alias("wage"))
    return aggregates.stock_and_mean(kept, "territory", "sector", "wage")
