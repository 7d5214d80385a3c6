import re

import pytest
from pyspark.sql import functions as F

from docweave.functions import answers, codecs, text as tx


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def py_clean(text):
    lines = []
    for line in text.split("\n"):
        line = line.strip()
        if line and not re.match(r"^[\s\-_=*+.]+$", line):
            lines.append(re.sub(r"([^\w\s])\1{4,}", r"\1\1", line))
    return "\n".join(lines).strip()


CLEAN = ["", "  a \n\n\n ---- \n b!!!!!! c \n ===...=== ", "é_____ \n　wide　\nwait......", "::::: x\n*+*", "one\r\ntwo", "....\n", "中文，，，，，，好"]


def test_clean_lines(spark):
    assert column(spark, CLEAN, tx.clean_lines) == [py_clean(t) for t in CLEAN]
    assert column(spark, [None], tx.clean_lines) == [None]


def test_clean_ocr(spark):
    assert column(spark, [" a ||| b ____ c..... d \n\te ", None, "|x|", "__"], tx.clean_ocr) == ["a  b  c... d e", "", "|x|", "__"]


def test_page_markers(spark):
    assert column(spark, ["a\fb\f", "a"], tx.page_markers) == ["a" + tx.PAGE_BREAK + "b" + tx.PAGE_BREAK, "a"]


def test_garbage(spark):
    good = "This is an ordinary sentence with quite enough letters in it to pass. " * 2
    texts = [good, "short", None, "", good + "x" * 21, "." * 5 + "?!,;" * 40, good.replace(" ", "\x01")]
    assert column(spark, texts, tx.text_is_garbage) == [False, True, True, True, True, True, False]
    units = [good, "abc" * 11 + good, good + "\x02" * 40 + "a", " " * 60, None, good + "ab" * 10]
    assert column(spark, units, tx.content_is_garbage) == [False, True, True, True, True, False]
    # A carriage return is a character like others in a run, a newline is not.
    assert column(spark, ["a\r" * 11, "\n" * 30], tx.has_repeated_unit) == [True, False]


def test_repeats_at_any_place(spark):
    texts = []
    for unit in ("a", "é😀", "abc", "x yz", "12345", "abcdef", "1234567", "😀bcdefgh", "abcdefghi", "0123456789", "abcdefghijk", "\n", "ab\n"):
        texts += ["".join(chr(200 + i) for i in range(before)) + unit * n + "+-" for n in (10, 11, 21) for before in (*range(42), 77)]
    assert column(spark, texts, tx.has_repeated_unit) == [bool(re.search(r"(.{1,10})\1{10,}", x)) for x in texts]
    assert column(spark, texts, tx.has_long_run) == [bool(re.search(r"(.)\1{20,}", x)) for x in texts]
    few = [x[:30] for x in texts]
    for times, longest in ((2, 3), (3, 1), (4, 10)):
        assert column(spark, few, lambda x, n=times, m=longest: tx.has_repeated_unit(x, n, m)) == [bool(re.search(rf"(.{{1,{longest}}})\1{{{times - 1},}}", x)) for x in few]
    ends = ["x" + "\u3000" * 48 + "y", "x" + " " * 47 + "y", " \n" * 60 + "z", "q" * 49 + " " * 99, " " * 9 + "q" * 50 + "\n"]
    assert column(spark, ends, lambda x: tx.content_is_garbage(x, repeated_unit=F.lit(False))) == [len(x.strip()) < 50 for x in ends]


def test_repetition_flags_of_null_and_long_texts(spark, tmp_path):
    from docweave.plans import catalog

    text = "".join(chr(97 + i * i % 23) + " " * (i % 7 == 0) for i in range(400_000))
    spark.createDataFrame([(1, text), (2, None), (3, text + "x" * 21), (4, text + "ab" * 11)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[1:] for r in catalog.text_repetition_flags(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(False, False, False, False), (False, False, None, None), (True, True, True, True), (False, True, False, True)]


def test_quality_flags_of_any_length(spark, tmp_path):
    from docweave.plans import catalog

    texts = ["", None, "\n", "\x01", "😀" * 85 + "é" * 15, "-" * 86 + "é" * 14, "\x01" * 10 + "q" * 90, "\x01" * 11 + "q" * 89]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r)[1:] for r in catalog.text_quality_flags(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert got == [(True, False, False), (None, None, None), (True, True, False), (True, True, True), (False, False, False), (False, True, False), (False, False, False), (False, False, True)]


def test_mojibake(spark):
    broken = "naïve café déjà vu".encode().decode("latin-1")
    assert column(spark, [broken, "naïve café", "short", None, "Ã©" * 20], tx.is_mojibake) == [codecs.looks_broken(broken), False, False, False, True]
    text = "é" * 30
    once = text.encode().decode("latin-1")
    assert column(spark, [once, text, "plain text here", None, "€uro" * 9], codecs.fix_mojibake) == [text, text, "plain text here", None, "€uro" * 9]
    assert codecs.repair("“" * 12 + "Ã©" * 9) == "“" * 12 + "Ã©" * 9  # cannot be read back


def test_mixed_encoding(spark):
    cases = {"﻿a": "a", "ï»¿b": "b", "itâ\u0080\u0099s": "it's", "â€œqâ€™": "\"q'", "cafÃ©": "café", "5Â°": "5°", "x\x96y": "x–y", "plain": "plain"}
    assert column(spark, list(cases), tx.fix_mixed_encoding) == list(cases.values())
    assert [tx.fix_mixed_encoding_py(k) for k in cases] == list(cases.values())


def test_decode(spark):
    data = ["é".encode(), "é€".encode("cp1252"), b"", None, "hi".encode("utf-16")]
    assert column(spark, data, codecs.decoded, "binary") == ["é", "é€", "", "", "hi"]


def test_hanzi_and_languages(spark):
    texts = ["器官", "“quotes” – €", "\U00020001", "abc", "", None]
    assert column(spark, texts, tx.contains_hanzi) == [True, False, True, False, False, False]
    assert column(spark, texts, lambda x: tx.contains_hanzi(x, legacy=True)) == [True, True, False, False, False, False]
    assert column(spark, texts, lambda x: tx.language_fits(x, "zh")) == [True, False, True, False, True, True]
    assert column(spark, texts, lambda x: tx.language_fits(x, "en")) == [False, True, False, True, True, True]
    assert column(spark, texts, lambda x: tx.language_fits(x, "fr")) == [True] * 6
    assert column(spark, ["a", "é"], tx.is_ascii) == [True, False]


def test_places(spark):
    names = ["四川", "四川省", "广西自治区", "香港特别行政区", " 北京市 ", "Paris", "某地", None, ""]
    assert column(spark, names, tx.place_name) == ["Sichuan", "Sichuan Province", "Guangxi Autonomous Region", "Hong Kong Special Administrative Region", "Beijing City", "Paris", "某地", None, ""]


def test_paths(spark):
    paths = ["/a/b.c/Name.TXT", "x.tar.gz", ".hidden", "/a/none", "/a/"]
    assert column(spark, paths, tx.file_name) == ["Name.TXT", "x.tar.gz", ".hidden", "none", ""]
    assert column(spark, paths, tx.file_suffix) == [".txt", ".gz", "", "", ""]
    assert column(spark, paths, tx.file_stem) == ["Name", "x.tar", ".hidden", "none", ""]


def test_bibliography(spark):
    entry = '@article{doe2020deep,\n title = {Deep Things},\n author="Doe, J.",\n year={2020},\n booktitle={Proc}\n}'
    assert column(spark, [entry, "no"], tx.bibtex_key) == ["doe2020deep", ""]
    assert [column(spark, [entry], lambda x, n=n: tx.bibtex_field(x, n))[0] for n in ("title", "author", "year", "journal")] == ["Deep Things", "Doe, J.", "2020", None]
    assert column(spark, [entry], tx.bibtex_journal) == ["Proc"]
    assert column(spark, ["c. 1999/2000", "no", None, "12345"], tx.year_of) == [1999, None, None, 1234]


def test_abstract(spark):
    long = "words and words " * 6
    rows = spark.createDataFrame([({"abstract": "given"}, ""), ({}, f"Title\nAbstract\n{long}\n\nIntroduction"), ({}, "Abstract\nshort\n\n"), ({}, f"Summary: {long}\n\nx")], "m map<string,string>, t string")
    got = [r.a for r in rows.select(tx.abstract_of(F.struct(F.try_element_at("m", F.lit("abstract")).alias("abstract")), F.col("t")).alias("a")).collect()]
    assert got == ["given", long.strip(), None, long.strip()]


def test_abstract_ends_at_a_blank_line(spark):
    short, exact = "x" * 49, ".5 g of it " + "y" * 39
    texts = [f"Title\n\nAbstract\n{short}\n\nMain part", f"Title\n\nAbstract:\n{exact}\n\nMain part", f"Abstract\n{'z' * 2001}\n\nabstract\n{exact}", f"Abstract\n{'z' * 2000}", f"Summary. {short}\n\nMore of it", None]
    assert column(spark, texts, lambda x: tx.abstract_of(F.struct(F.lit(None).cast("string").alias("abstract")), x)) == [None, exact, None, "z" * 2000, None, None]


def test_metadata_keys(spark):
    rows = spark.createDataFrame([({"A-b C": " x ", "empty": " ", "none": None},)], "m map<string,string>")
    assert rows.select(tx.normalise_metadata(F.col("m"))).first()[0] == {"a_b_c": "x"}


# Answers.


def both(spark, values, f):
    return [(r.y.value, r.y.error is not None) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_enum(spark):
    got = both(spark, [" Yes ", "'yes'", "no", None, "maybe"], lambda x: answers.enum_answer(x, ["Yes", "no"], False))
    assert got == [("Yes", False), ("Yes", False), ("no", False), (None, True), (None, True)]
    assert both(spark, ["yes", "Yes"], lambda x: answers.enum_answer(x, ["Yes"])) == [(None, True), ("Yes", False)]
    with pytest.raises(ValueError):
        answers.enum_answer(F.lit(""), [])


def test_enum_list(spark):
    values = ['["b","a","b"]', "a, b", '"a"', "a", "[]", '["a","z"]', "a,b,c", "5", '{"a":1}', "", None, '["A"]']
    got = both(spark, values, lambda x: answers.enum_list_answer(x, ["a", "b", "c"], min_items=1, max_items=2))
    assert got == [(["b", "a"], False), (["a", "b"], False), (["a"], False), (["a"], False)] + [(None, True)] * 8
    assert both(spark, ["[]", '["A","a"]'], lambda x: answers.enum_list_answer(x, ["a"], False, unique=False)) == [([], False), (["a", "a"], False)]


def test_simple(spark):
    assert both(spark, [" TRUE", "off", "2", None], lambda x: answers.simple_answer(x, "boolean")) == [(True, False), (False, False), (None, True), (None, True)]
    assert both(spark, ["42", "-1_000", "4.0", "x"], lambda x: answers.simple_answer(x, "integer")) == [(42, False), (-1000, False), (None, True), (None, True)]
    assert both(spark, ["4", ".5", "1e3", "x"], lambda x: answers.simple_answer(x, "float")) == [(4.0, False), (0.5, False), (1000.0, False), (None, True)]
    assert both(spark, [" 中 ", "abc", ""], lambda x: answers.simple_answer(x, "string", "zh")) == [("中", False), (None, True), ("", False)]


def test_lax(spark):
    assert column(spark, ["5", "5.0", "5.5", "x", None], lambda x: answers.lax(x, "integer")) == [5, 5, None, None, None]
    assert column(spark, ["yes", "N", "1", "2"], lambda x: answers.lax(x, "boolean")) == [True, False, True, None]


def test_truthy_and_meaningful(spark):
    assert column(spark, ["", " ", "a", None], lambda x: answers.truthy(x, "string")) == [False, True, True, False]
    assert column(spark, [0, 2, None], lambda x: answers.truthy(x, "int"), "int") == [False, True, False]
    assert column(spark, [" ", "NULL", "nulls", None], lambda x: answers.meaningful(x, "string")) == [None, None, "nulls", None]
    assert column(spark, [[], ["a"], None], lambda x: answers.meaningful(x, "array<string>"), "array<string>") == [None, ["a"], None]
