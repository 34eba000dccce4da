import pytest

from stratograph.llm import documented as d


@pytest.mark.parametrize("doc", ["", "  ", "TODO", "FIXME document this", "see above", "See base class.", "{@inheritDoc}", "@param\n@return", ":param a:\n:param b:\n:returns:", "Parameters\n----------", "noqa: D103", "-----", "Go function loadUser", "Load user.", "The load user method.",
                                 "This is the method load user of this class.", "loadUser()", "Copyright the x team. All rights reserved.", "Part of the x tree. Use is governed by the terms kept in the root folder.", "Auto-generated method stub", "deprecated", "?", "...", "N/A", "docs pending",
                                 "Documentation for this item will be added later by the owning team", "For details please refer to the documentation of the parent class.", "Does what its name says and nothing else.", "/** TODO */", '"""TBD"""', None])
def test_says_nothing(doc):
    assert not d.says_something(doc, "A.loadUser")


@pytest.mark.parametrize("doc", ["Never blocks, even when the lease has no zone.", "Load user.\n\nReturns the first one that is free.", "See scope for the layout; this one also drops any view without a peer.", ":param x: how many rows to keep\n:returns: the last one", "region 값을 42개까지 보관하고 가득 차면 지웁니다.",
                                 "/// <summary>\n/// Reads in blocks of ten.\n/// </summary>", "Copyright the x team.\nKeeps rows sorted by age.", "@param peer the partial timer, never longer", "読み込みを待ちます。", "Inherited switches are skipped unless fresh."])
def test_says_something(doc):
    assert d.says_something(doc, "A.loadUser")


@pytest.mark.parametrize("doc", [
    "Siehe oben.", "Noch zu dokumentieren", "Siehe die Dokumentation der Basisklasse.", "Beschreibung folgt später.", "Geerbt von der Oberklasse", "Keine Dokumentation vorhanden, wird nachgereicht.",
    "voir la documentation", "à compléter plus tard", "Voir ci-dessus.", "Hérité de la classe parente.", "Description à venir", "Veuillez consulter la documentation de la classe mère.",
    "ver la clase base", "Véase más arriba.", "Pendiente de documentar", "Documentación pendiente.", "Heredado de la clase padre", "Se añadirá más adelante",
    "Veja a classe base.", "Documentação pendente", "Herdado da classe pai.", "Ver acima", "A documentação será adicionada depois.",
    "Zie de documentatie.", "Nog te documenteren", "Beschrijving volgt later.", "Overgenomen van de bovenliggende klasse", "Zie hierboven",
    "См. выше.", "Описание будет добавлено позже.", "Унаследовано от базового класса", "Смотрите документацию родительского класса", "Документация отсутствует",
    "参见父类。", "文档待补充", "请参阅接口的说明。", "继承自基类", "暂无说明", "上記を参照してください。", "後で追加予定", "親クラスから継承されます。", "説明なし", "ドキュメントは後で作成します。", "위를 참조하세요.", "나중에 문서화 예정", "상위 클래스에서 상속됨", "설명 없음", "문서를 참고하십시오."])
def test_says_nothing_in_any_language(doc):
    assert not d.says_something(doc, "A.loadUser")


@pytest.mark.parametrize("doc", [
    "Siehe oben, liest aber zusätzlich den Zeitstempel.", "Ergänzt fehlende Einträge der Tabelle.", "Vor dem Speichern wird die Abfrage verglichen.", "Vérifie que la branche existe encore.", "Voir quels fichiers ont changé depuis hier.", "Ver quién está conectado ahora.",
    "Añadir filas nuevas al índice.", "Adicionar linhas novas ao índice.", "Voegt ontbrekende regels toe aan de tabel.", "Добавить строки в таблицу индекса.", "Проверяет, что ветка ещё существует.", "从缓存读取最近的记录。", "保存する前にもう一度比較します。", "파일을 읽고 오래된 항목을 지웁니다.", "返回第一个空闲的连接。", "古い行を削除して件数を返します。"])
def test_says_something_in_any_language(doc):
    assert d.says_something(doc, "A.loadUser")


@pytest.mark.parametrize("ext,code,doc", [
    ("py", '# above it\n@deco(1, ")")\nasync def f(a: str = ":") -> int:\n    r"""Inner text."""\n    return 1\n', "Inner text.\nabove it"), ("py", "# far\n\ndef f():\n    # within\n    return 'x'\n", ""), ("py", "def f(\n    a,\n):\n    # c\n    'one line'\n", "one line"),
    ("java", "/**\n * Doc here.\n */\n@Override(x = \"}\")\npublic void f() { a(\"}\"); /* } */ }\n", "Doc here."), ("java", "// far\n\npublic void f() { }", ""), ("go", "// One.\n// Two.\nfunc (s *S) F() error {\n\t// within\n}\n", "One.\nTwo."), ("rs", "/// Doc.\n#[inline]\npub fn f() -> i32 { 1 }\n", "Doc."),
    ("ts", "/** A. */\nload(a: string): Frame {\n", "A."), ("php", "# Note.\nfunction f($x) { }\n", "Note."), ("c", "", "")])
def test_take_apart(ext, code, doc):
    assert d.take_apart(code, ext)[0] == doc


def test_body_is_balanced_and_bare():
    _, header, bare = d.take_apart('/** X. */\nint f(int a) {\n  if (a) { s = "}"; }\n}\n', "c")
    assert header == "int f(int a)" and bare.startswith("int f") and bare.rstrip().endswith("}")


def test_pairs(spark):
    rows = [("symbol:a.py:f", "f", None, None, "def f(x):\n    '''Waits until the tree has settled.'''\n    return x\n", None, "x"), ("symbol:a.py:f", "f", None, None, "def f(x):\n    '''Waits until the tree has settled.'''\n    return x\n", None, "x"),
            ("symbol:a.go:g", "g", "func g()", "Never blocks on writes.", "func g() {}", "a.go", "x"), ("symbol:a.go:h", "h", "func h()", "TODO", "func h() {}", "a.go", "x"), ("symbol:a.go:i", "i", None, "Never blocks on writes.", " \n", "a.go", "x"), ("symbol:a.go:j", "j", None, "Never blocks on writes.", None, "a.go", "x"),
            (None, "k", None, "Never blocks on writes.", "x", "a.go", "x"), ("symbol:a.go:l", None, None, "Never blocks on writes.", "func l() {}" + "x" * 200000, None, "x")]
    df = spark.createDataFrame(rows, "id string, name string, signature string, docstring string, code string, file_path string, documentation string")
    got = {r["id"]: r for r in d.documented_functions(df).collect()}
    assert set(got) == {"symbol:a.py:f", "symbol:a.go:g", "symbol:a.go:l"} and got["symbol:a.py:f"]["signature"] == "def f(x):" and got["symbol:a.py:f"]["origin"] == "code" and got["symbol:a.go:g"]["origin"] == "docstring"
    assert {r["id"] for r in d.documented_ids(df).collect()} == set(got) and d.documented_functions(df.limit(0)).count() == 0
