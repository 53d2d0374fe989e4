"""Garbled text: many pairs of pages are found and restored, unusual letters on purpose are left alone."""

import random

import pytest

from lodeplane.llm import garbled as G

SENTENCES = {
    "de": ["Für die Prüfung müssen Dateien geöffnet und verglichen werden.", "Größere Pakete werden künftig früher übertragen – höchstens fünf.", "Ungültige Einträge heißen im Bericht „offen“."],
    "ru": ["Нужно добавить тесты для второго вызова функции.", "Проверка нашла устаревшие ссылки на удалённые записи.", "Обработчик возвращает пустой ответ, если ключ не задан."],
    "en": ["It’s safe to run the step twice, since the cursor keeps its own level.", "Please rename the column; “level” says nothing about it.", "Call depth is high – more than the limit agreed."],
    "ja": ["設定ファイルの読み込みに失敗した場合は、既定値を使います。", "この経路はまだ検証されていません。"],
}
ODD = ["Test names use Ångström, Ærø, Þór and Ðuro on purpose.", "Table of letters: Ã Õ Ñ Ç È É Ê Ë ß ÿ ž Ž.", "The lexer prints “�” (U+FFFD) for a byte it can’t read; this is intended.", "ATENÇÃO: NÃO ALTERE A CONFIGURAÇÃO DE PRODUÇÃO."]


def corpus():
    random.seed(1)
    rows, bad = [], {}
    for i in range(700):
        lang = random.choice(list(SENTENCES))
        rows.append((i, " ".join(random.choice(SENTENCES[lang]) for _ in range(6)), f"s{i % 5}"))
    for j in range(60):
        rows.append((1000 + j, random.choice(SENTENCES["en"]) + " " + ODD[j % 4], "s1"))
    for k, (lang, written, read) in enumerate([("de", "utf-8", "cp1252"), ("de", "utf-8", "latin-1"), ("en", "utf-8", "cp1252"), ("ru", "utf-8", "latin-1"), ("ru", "cp1251", "latin-1"), ("ru", "koi8-r", "cp1251"), ("de", "utf-8", "cp437"), ("de", "utf-8", "mac-roman"), ("ja", "utf-8", "latin-1"), ("ja", "shift_jis", "latin-1")]):
        text = " ".join(random.choice(SENTENCES[lang]) for _ in range(4))
        rows.append((2000 + k, text.encode(written, "ignore").decode(read, "replace"), "s2"))
        bad[2000 + k] = text
    lost = SENTENCES["de"][0].encode("latin-1").decode("utf-8", "replace")
    rows += [(3000, lost, "s3"), (3001, None, "s3"), (3002, "", None), (3003, "plain ascii " * 2000, None)]
    return rows, bad


@pytest.fixture(scope="module")
def result(spark):
    rows, bad = corpus()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, page string")
    return {r.doc_id: r for r in G.garbled_texts(df).collect()}, bad


def test_found_and_no_more(result):
    got, bad = result
    assert set(got) == set(bad) | {3000}


def test_restored(result):
    got, bad = result
    exact = sum(got[k].text == t for k, t in bad.items())
    assert exact >= 7, [(k, got[k].text, t) for k, t in bad.items() if got[k].text != t]


def test_learned_mapping(spark, result):
    rows, _ = corpus()
    df = spark.createDataFrame([r for r in rows if r[0] < 1000 or r[0] in (2004,)], "doc_id bigint, text string, source string")
    pairs = {(r.seen, r.letter) for r in G.learned_mapping(G.garbled_texts(df)).collect()}
    assert ("î", "о") in pairs and ("å", "е") in pairs


def test_no_hypothesis_is_dropped_before_the_choice(spark):
    rows, _ = corpus()
    rows = [r for r in rows if r[0] < 1000] + [(4000 + i, "Las señales son pequeñas y la configuración no cambia.", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    one = spark.createDataFrame([("señales".encode().decode("latin-1"),)], "word string")
    got = G.readings(one, G.bigram_counts(G.word_counts(docs))).collect()
    tied = {(p.page, p.true) for r in got if r.fixed == "señales" for p in r.pages}
    assert tied >= {(p, "utf-8") for p in ("cp1252", "cp1254", "iso8859-15", "iso8859-9", "latin-1")}
    assert len({r.fixed for r in got}) == len(got)


def test_restored_share_of_the_truth(spark):
    """Restored words against the truth, over swaps of many pages: the share is also given in the README."""
    random.seed(3)
    rows, _ = corpus()
    rows, truth = [(i + 10_000 * k, t, src) for i, t, src in rows if i < 2000 for k in range(4)], {}
    swaps = [("de", "utf-8", "cp1252"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("ru", "koi8-r", "cp1252"), ("de", "utf-8", "mac-roman"), ("de", "cp1252", "cp437"), ("ja", "utf-8", "cp932"), ("ja", "shift_jis", "cp1252"), ("en", "utf-8", "cp1250")]
    for k in range(18):
        lang, written, read = swaps[k % len(swaps)]
        text = " ".join(random.choice(SENTENCES[lang]) for _ in range(2))
        rows.append((5000 + k, text.encode(written, "ignore").decode(read, "replace"), f"t{k % len(swaps)}"))
        truth[5000 + k] = text.encode(written, "ignore").decode(written)
    got = {r.doc_id: r.text for r in G.garbled_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert set(got) == set(truth)
    right = sum(a == b for k, t in truth.items() for a, b in zip(got[k].split(), t.split()))
    assert right >= 0.9 * sum(len(t.split()) for t in truth.values())


WORDS = "нужно добавить тесты для второго вызова функции проверка нашла устаревшие ссылки удалённые записи обработчик возвращает пустой ответ если ключ задан сервис больше зависит общего хранилища изменение файле приводит полной перестройке графа каждый запрос должен завершаться сохранением состояния после этого очередь снова открыта новых сообщений таблица содержит строки каждого дня месяца года поэтому размер растёт быстро".split()


def test_page_that_nobody_knows(spark):
    """A page made up here: the letters of the text stand in a shuffled order among the signs of another alphabet."""
    random.seed(5)
    say = lambda n: " ".join(random.choice(WORDS) for _ in range(n))
    letters = sorted(set("".join(WORDS)))
    signs = random.sample([chr(c) for c in range(0xC0, 0x100)], len(letters))
    page = str.maketrans(dict(zip(letters, signs)))
    rows = [(i, say(40), f"s{i % 4}") for i in range(300)] + [(900 + i, random.choice(SENTENCES["de"]), "s1") for i in range(60)]
    truth = {2000 + i: say(30) for i in range(25)}
    rows += [(k, t.translate(page), "old") for k, t in truth.items()]
    got = {r.doc_id: r for r in G.garbled_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert set(got) == set(truth) and {(r.page, r["true"]) for r in got.values()} == {("learned", "cyrillic")}
    right = sum(a == b for k, t in truth.items() for a, b in zip(got[k].text, t))
    assert right >= 0.95 * sum(map(len, truth.values()))
    mapping = {r.seen: r.letter for r in G.learned_mapping(spark.createDataFrame(list(got.values()))).collect()}
    assert sum(mapping.get(chr(k)) == v for v, k in zip(letters, (ord(s) for s in signs))) >= 0.85 * len(letters)


def test_equal_ids_are_judged_each(spark):
    bad = SENTENCES["de"][0].encode().decode("latin-1")
    rows = [(i, SENTENCES["de"][i % 3], "s") for i in range(60)] + [(7, bad * 2, "s"), (7, "ok", "s"), (7, bad * 2, "s"), (None, bad * 3, None)]
    got = G.garbled_texts(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted((r.doc_id is None, r.text) for r in got) == [(False, SENTENCES["de"][0] * 2), (True, SENTENCES["de"][0] * 3)]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert G.garbled_texts(empty).collect() == [] and G.garbled_keys(empty).collect() == []
