"""Sheets in the registry's own layout."""

from strataflow.sources import record_sheets

PAGE = """<html><body><table><tr><td>Poço: 3500012345</td><td>UF: SP</td><td>Município: São  José</td><td> Localidade: Sítio Água Limpa </td></tr></table>
<table><tr><td class="subsection-header">Filtros:</td></tr><tr><td class="label-cell">De (m):</td><td class="label-cell">Até (m):</td></tr>
<tr><td class="data-cell">10,5</td><td class="data-cell">20</td></tr><tr><td class="data-cell">30</td><td class="data-cell">25</td></tr><tr><td class="data-cell">x</td><td class="data-cell">9</td></tr></table>
<table><tr><td class="subsection-header">Perfil do revestimento</td></tr><tr><td class="label-cell">De (m)</td><td class="label-cell">Até (m)</td></tr><tr><td class="data-cell">0</td><td class="data-cell">10.5</td></tr></table>
<table><tr><td class="subsection-header">Dados Litológicos</td></tr><tr><td class="label-cell">De (m)</td><td class="label-cell">Até (m)</td><td class="label-cell">Litologia</td><td class="label-cell">Descrição Litológica</td></tr>
<tr><td class="data-cell">0</td><td class="data-cell">4</td><td class="data-cell">Solo</td><td class="data-cell">argila</td></tr><tr><td class="data-cell">4</td><td class="data-cell">50</td><td class="data-cell">Granito</td><td class="data-cell"></td></tr></table>
<table><tr><td class="subsection-header">Formação Geológica</td></tr><tr><td class="label-cell">Profundidade Inicial (m)</td><td class="label-cell">Profundidade Final (m)</td><td class="label-cell">Tipo de Formação</td></tr><tr><td class="data-cell">0</td><td class="data-cell">50</td><td class="data-cell">Pré-cambriano</td></tr></table>
<table><tr><td class="subsection-header">Entradas d'água</td></tr><tr><td class="label-cell">Profundidade</td></tr><tr><td class="data-cell">33,0 m</td></tr><tr><td class="data-cell">0</td></tr></table>
<table><tr><td class="subsection-header">Aquífero no ponto</td></tr><tr><td class="label-cell">Tipo</td></tr><tr><td class="data-cell">Livre</td></tr></table>
<table><tr><td class="subsection-header">Teste de Bombeamento</td></tr><tr><td class="label-cell">Vazão Livre:</td><td class="label-cell">Vazão após estabilização:</td><td class="label-cell">Nível Estático</td></tr><tr><td class="data-cell">9,9 m3/h</td><td class="data-cell">4,00 m3/h</td><td class="data-cell">-</td></tr>
<tr><td class="label-cell">N.E. (m)</td><td class="label-cell">Nível Dinâmico</td><td class="label-cell">Duração</td><td class="label-cell">Vazão Específica</td></tr><tr><td class="data-cell">2.5</td><td class="data-cell">18</td><td class="data-cell">24 h</td><td class="data-cell">0,26</td></tr></table>
<table><tr><td class="subsection-header">Observações</td></tr><tr><td class="label-cell">Nota</td></tr><tr><td class="data-cell">em uso</td></tr></table></body></html>"""


def test_registry_layout(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<html>error</html>"), (4, PAGE.replace("4,00", "0"))], "id int, html string")
    got = {r.id: r for r in record_sheets.test_values(record_sheets.sheet_records(pages)).collect()}
    r = got[1]
    assert (r.code, r.state, r.municipality, r.locality) == ("3500012345", "SP", "São José", "Sítio Água Limpa")
    layers = lambda x: [tuple(v) for v in x]
    assert layers(r.screens) == [(10.5, 20.0, None)] and layers(r.casing) == [(0.0, 10.5, None)]
    assert layers(r.lithology) == [(0.0, 4.0, "Solo — argila"), (4.0, 50.0, "Granito")]
    assert layers(r.formations) == [(0.0, 50.0, "Pré-cambriano")] and r.entries == [33.0]
    assert layers(r.aquifer) == [("Tipo", "Livre")] and layers(r.other) == [("observacoes", "Nota", "em uso")]
    assert (r.flow_m3h, r.qs_sheet, r.static_m, r.dynamic_m, r.hours) == (4.0, 0.26, 2.5, 18.0, 24.0)
    assert got[4].flow_m3h == 9.9  # no flow after stabilisation: the free one
    for empty in (got[2], got[3]):
        assert empty.code is None and empty.flow_m3h is None and empty.screens == [] == empty.test


def test_sections_and_folding():
    kinds = {"filtros": "screens", "revestimento dos filtros": "casing", "dados litologicos": "lithology", "formacao geologica": "formations", "entrada d'agua": "entries", "aquifero": "aquifer", "teste": "test", "dados de bombeamento": "test", "bomba": "other"}
    assert {k: record_sheets.section_kind(k) for k in kinds} == kinds
    assert record_sheets.folded("ÁREA ÇÃO") == "area cao" and record_sheets.tolerant_number("cerca de -4,5 m") == -4.5 and record_sheets.tolerant_number(None) is None
