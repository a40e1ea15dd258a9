"""Well record sheets in HTML: cached pages and their nested records."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

C = F.col
#: Pages shorter than this are error pages.
LEAST_BYTES = 1000

_INTERVAL = T.StructType([T.StructField("top", T.DoubleType()), T.StructField("base", T.DoubleType()), T.StructField("label", T.StringType())])
RECORD = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("municipality", T.StringType()),
        T.StructField("intervals", T.MapType(T.StringType(), T.ArrayType(_INTERVAL))),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of the cached Latin-1 pages below ``path``, error pages left out."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") >= LEAST_BYTES)
    return files.select("path", F.decode("content", "ISO-8859-1").alias("html"))


def number(text: str) -> float | None:
    try:
        return float(text.strip().replace(",", "."))
    except ValueError:
        return None


class _Sheet(HTMLParser):
    """Collects (section, row of cells) in order; a cell is of class label-cell or data-cell, a section of subsection-header."""

    def __init__(self) -> None:
        super().__init__()
        self.section, self.kind, self.rows, self.text = "", "", [], ""

    def handle_starttag(self, tag, attrs):
        kind = dict(attrs).get("class") or ""
        if tag == "tr":
            self.rows.append((self.section, []))
        if kind in ("subsection-header", "label-cell", "data-cell"):
            self.kind, self.text = kind, ""

    def handle_data(self, data):
        if self.kind:
            self.text += data

    def handle_endtag(self, tag):
        if not self.kind or tag not in ("td", "th", "div"):
            return
        text = " ".join(self.text.split())
        if self.kind == "subsection-header":
            self.section = text
            self.rows.append((text, []))
        elif self.rows:
            self.rows[-1][1].append((self.kind, text))
        self.kind = ""


def parse_sheet(html: str | None) -> dict:
    """The nested record of one page: interval sections as lists of (top, base, label), other sections as key and value."""
    sheet = _Sheet()
    sheet.feed(html or "")
    out: dict = {"code": None, "municipality": None, "intervals": {}, "fields": {}}
    for section, cells in sheet.rows:
        data = [t for k, t in cells if k == "data-cell"]
        labels = [t for k, t in cells if k == "label-cell"]
        if labels and data:
            out["fields"].update({f"{section}/{a}": b for a, b in zip(labels, data, strict=False)})
        elif len(data) >= 2 and number(data[0]) is not None and number(data[1]) is not None:
            row = {"top": number(data[0]), "base": number(data[1]), "label": data[2] if len(data) > 2 else None}
            out["intervals"].setdefault(section, []).append(row)
    out["code"] = out["fields"].get("General/Code")
    out["municipality"] = out["fields"].get("General/Municipality")
    return out


@F.pandas_udf(RECORD)
def parse_pages(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The nested record of each page; a null or foreign page has empty sections."""
    for pages in batches:
        yield pd.DataFrame([parse_sheet(h) for h in pages], columns=["code", "municipality", "intervals", "fields"])


def value_by_words(fields: Column, words: list[str]) -> Column:
    """The first field, by key, whose key holds all ``words`` without regard to case and whose value is a number."""
    # map entries can't be ordered, so the keys are
    hit = F.filter(F.map_entries(fields), lambda e: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(e.key), w)) & F.replace(e.value, F.lit(","), F.lit(".")).try_cast("double").isNotNull())
    return F.replace(F.get(F.sort_array(hit), F.lit(0)).value, F.lit(","), F.lit(".")).try_cast("double")


# --- sheets in the registry's own layout ---

# The registry's labels (accents folded), section names and the accents that it uses.
HEAD_LABELS = {"poco": "code", "uf": "state", "municipio": "municipality", "localidade": "locality"}
INTERVAL_SECTIONS = {"filtro": "screens", "revestimento": "casing", "litol": "lithology", "formacao": "formations"}
OTHER_SECTIONS = {"entrada": "entries", "aquifero": "aquifer", "teste": "test", "bombeamento": "test"}
ENDS = {"formations": ("profundidade inicial (m)", "profundidade final (m)")}
FROM_TO = ("de (m)", "ate (m)")
LABELS = {"lithology": ("litologia", "descricao litologica"), "formations": ("tipo de formacao",)}
ENTRY_DEPTH = "profundidade"
ACCENTS, PLAIN = "áàãâéêíóôõúç", "aaaaeeiooouc"
#: Words that a test's keys have to hold, for each value, in order of preference.
TEST_WORDS = {
    "flow_m3h": (("vazao", "estab"), ("vazao", "livre")),
    "qs_sheet": (("vazao", "espec"),),
    "static_m": (("estatico",), ("n.e",)),
    "dynamic_m": (("dinamico",), ("n.d",)),
    "hours": (("duracao",), ("tempo", "bombeamento")),
}

_PAIRS = "array<struct<key:string,value:string>>"
_LAYERS = "array<struct<top:double,base:double,label:string>>"
SHEET = f"code string, state string, municipality string, locality string, screens {_LAYERS}, casing {_LAYERS}, lithology {_LAYERS}, formations {_LAYERS}, entries array<double>, aquifer {_PAIRS}, test {_PAIRS}, other array<struct<section:string,key:string,value:string>>"


def folded(text: str) -> str:
    """Lower case without the registry's accents."""
    return text.lower().translate(str.maketrans(ACCENTS, PLAIN))


class _Tables(HTMLParser):
    """Cells in order: (table, row, class, text); nested tables are tables of their own."""

    def __init__(self) -> None:
        super().__init__()
        self.cells: list[list] = []
        self.path: list[int] = []  # tables that are open
        self.open: list[list] = []  # cells that are open
        self.tables = self.row = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables += 1
            self.path.append(self.tables)
        elif tag == "tr":
            self.row += 1
        elif tag == "td":
            self.open.append([self.path[-1] if self.path else 0, self.row, (dict(attrs).get("class") or "").split(), ""])
            self.cells.append(self.open[-1])

    def handle_data(self, data):
        if self.open:
            self.open[-1][3] += data

    def handle_endtag(self, tag):
        if tag == "table" and self.path:
            self.path.pop()
        elif tag == "td" and self.open:
            self.open.pop()


def section_kind(name: str) -> str:
    """Which part of the record a section belongs to, by the words that its folded name begins with or holds."""
    if name.startswith("filtro"):
        return "screens"
    for word, kind in [*INTERVAL_SECTIONS.items(), *OTHER_SECTIONS.items()]:
        if word != "filtro" and word in name:
            return kind
    return "other"


def sheet_record(html: str | None) -> dict:
    """The record of a page in the registry's layout.

    A table with a subsection-header is a section; its label-cells name the data-cells of the
    rows that follow. Intervals need both ends as numbers, the base below the top. A field of
    the head is any cell that begins with its label. What no section name claims is kept as
    ``other``, by section and key.
    """
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    out: dict = {c.split()[0]: [] for c in SHEET.split(", ")} | dict.fromkeys(HEAD_LABELS.values())
    tables: dict[int, list] = {}
    for table, row, kinds, text in parser.cells:
        text = " ".join(text.split())
        label, colon, value = text.partition(":")
        field = HEAD_LABELS.get(folded(label.strip()))
        if colon and field and (value := value.strip()):
            out[field] = "".join(ch for ch in value if ch.isdigit()) if field == "code" else value.split()[0] if field == "state" else value
        tables.setdefault(table, []).append((row, kinds, text))
    keyed: dict[str, dict] = {"aquifer": {}, "test": {}}
    for cells in tables.values():
        name = next((t for _, kinds, t in cells if "subsection-header" in kinds), None)
        if name is None:
            continue
        kind, labels = section_kind(folded(name.rstrip(": "))), []
        for row in dict.fromkeys(r for r, _, _ in cells):
            own = [(kinds, t) for r, kinds, t in cells if r == row]
            if named := [t.rstrip(": ") for kinds, t in own if "label-cell" in kinds]:
                labels = named
                continue
            values = [t for kinds, t in own if "data-cell" in kinds]
            if labels and any(values):
                _add(out, keyed, kind, folded(name.rstrip(": ")), dict(zip(labels, values, strict=False)))
    for kind, pairs in keyed.items():
        out[kind] = [{"key": k, "value": v} for k, v in pairs.items()]
    return out


def _add(out: dict, keyed: dict[str, dict], kind: str, section: str, record: dict[str, str]) -> None:
    plain = {folded(k): v for k, v in record.items()}
    if kind in keyed:
        keyed[kind].update(record)
    elif kind == "entries":
        depth = tolerant_number(plain.get(ENTRY_DEPTH))
        if depth is not None and depth > 0:
            out["entries"].append(depth)
    elif kind == "other":
        out["other"] += [{"section": section, "key": k, "value": v} for k, v in record.items()]
    else:
        top, base = (number(plain.get(k, "")) for k in ENDS.get(kind, FROM_TO))
        if top is not None and base is not None and base > top:
            label = " — ".join(v for k in LABELS.get(kind, ()) if (v := plain.get(k)))
            out[kind].append({"top": top, "base": base, "label": label or None})


def tolerant_number(text: str | None) -> float | None:
    """The first number in a text, with a comma or a point."""
    import re

    hit = re.search(r"-?\d+(?:[.,]\d+)?", text or "")
    return float(hit.group().replace(",", ".")) if hit else None


def _records(batches: Iterator[pd.DataFrame], keep: list[str], page: str) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.concat([pdf[keep].reset_index(drop=True), pd.DataFrame([sheet_record(h) for h in pdf[page]], columns=[c.split()[0] for c in SHEET.split(", ")])], axis=1)


def sheet_records(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` with the record of each in place of ``page``; a null or foreign page has empty parts."""
    keep = [c for c in pages.columns if c != page]
    kinds = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.mapInPandas(lambda it: _records(it, keep, page), kinds + SHEET)


def first_by_words(pairs: Column, words: tuple[str, ...]) -> Column:
    """The first number among the values of ``pairs``, in their order, whose key holds all ``words``, whatever case and accents."""
    key = lambda e: F.translate(F.lower(e.key), ACCENTS, PLAIN)
    value = lambda e: F.replace(F.regexp_extract(e.value, r"-?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    hit = lambda e: F.forall(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(key(e), w)) & value(e).isNotNull()
    return F.get(F.transform(F.filter(pairs, hit), value), F.lit(0))


def test_values(records: DataFrame) -> DataFrame:
    """``records`` with the values of the pumping test that TEST_WORDS names; a value that is 0 gives way to the next choice."""
    choice = lambda options: F.coalesce(*[F.when(v != 0, v) for o in options[:-1] for v in (first_by_words(C("test"), o),)], first_by_words(C("test"), options[-1]))
    return records.withColumns({name: choice(options) for name, options in TEST_WORDS.items()})
