"""Chunking, markup and text rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import markup, text
from tesserae.operators import chunking
from tesserae.operators.chunking import ChunkConfig, chunk_text


def test_small_text_is_one_chunk():
    assert chunk_text("One paragraph only.", ChunkConfig()) == ["One paragraph only."]
    assert chunk_text(" \n ", ChunkConfig()) == [] == chunk_text(None, ChunkConfig())


def test_paragraphs_are_packed():
    assert chunk_text("a b\n\nc d\n \ne f", ChunkConfig(4, 0)) == ["a b\n\nc d", "e f"]


def test_overlap_is_whole_sentences():
    got = chunk_text("One two three. Four five.\n\nSix seven eight nine.", ChunkConfig(6, 2))
    assert got == ["One two three. Four five.", "Four five.\n\nSix seven eight nine."]


def test_words_overlap():
    words = " ".join(f"word{i}" for i in range(1, 41))
    got = chunk_text(words, ChunkConfig(20, 5))
    assert [len(c.split()) for c in got] == [20, 20, 10] and got[1].split()[:5] == got[0].split()[-5:]


def test_an_overlap_that_leaves_no_room_is_dropped():
    got = chunking.split_words("aaa bbb cccccccccc dd", 10, 9, len)
    assert got == ["aaa bbb", "cccccccccc", "dd"]


def test_config():
    with pytest.raises(ValueError):
        ChunkConfig(10, 10)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab. \n?", max_size=300), st.integers(2, 12), st.integers(0, 5))
def test_chunks_cover_all_words(content, size, overlap):
    overlap = min(overlap, size - 1)
    chunks = chunk_text(content, ChunkConfig(size, overlap))
    assert all(c.strip() and len(c.split()) <= size + overlap for c in chunks)
    words, at = content.split(), 0
    for c in chunks:  # each chunk continues where the one before ended, or earlier
        mine = c.split()
        assert any(words[s : s + len(mine)] == mine for s in range(max(0, at - overlap - 1), at + 1))
        at = max(s + len(mine) for s in range(max(0, at - overlap - 1), at + 1) if words[s : s + len(mine)] == mine)
    assert at == len(words)


@pytest.mark.parametrize(("lines", "want"), [
    ("graph TD\nA --> B", "A leads to B"), ("graph TD\nC -.-> D", "C optionally leads to D"), ("flowchart LR\nA --- B", "A connects to B"),
    ("graph TD\nA --> B | Label text |", "A leads to B (Label text)"), ("graph TD\nA -->|yes| B", "A leads to B (yes)"),
    ("graph TD\nA[Start] --> B{Choice}\nB --> C((End))", "Start leads to Choice\nChoice leads to End"),
    ("sequenceDiagram\nAlice->>Bob: Hello Bob", "Alice sends to Bob: Hello Bob"), ("classDiagram\nAnimal --|> Dog", "Animal inherits from Dog"),
    ("classDiagram\nA *-- B", "A composes B"), ("erDiagram\nCUSTOMER ||--o{ ORDER : places", "CUSTOMER has one-to-many relationship with ORDER"),
    ("stateDiagram\n[*] --> idle\nidle --> busy", "idle transitions to busy"), ("graph TD\n%% note\nstyle A fill:#fff", "[diagram content extracted]"),
])
def test_diagrams(lines, want):
    assert markup.diagrams(f"x\n```mermaid\n{lines}\n```\ny") == f"x\n{want}\ny"


def test_mdx():
    page = "import A from 'a';\n\n\n\n# Title\n<Box>x</Box> text <Self a={1} />\n\nexport const meta = { a: 1 };\n"
    assert markup.mdx(page) == "# Title\n text"
    assert markup.mdx(page, True) == "[import removed]\n# Title\n[component removed] text [component removed]\n\n[export removed]"
    assert markup.mdx("import A from 'a';") == "[content removed]"
    assert markup.mdx("<A><B>x</B></A>") == "</A>"  # the nearest closing tag ends a component


def test_columns(spark):
    rows = spark.createDataFrame([("  # My Title  \nx", "/a/doc2.txt"), ("#no\nplain", "C:\\b\\doc2.tar.gz"), ("", "noext")], "t string, p string")
    assert [r[0] for r in rows.select(text.title(F.col("t"), F.col("p"))).collect()] == ["My Title", "doc2.tar", "noext"]
    code = spark.createDataFrame([("a\n```JS\nx\n```\nb ```\ny\n```",)], "t string")
    got = code.select(text.strip_fences(F.col("t"), "placeholder"), text.strip_fences(F.col("t"), "strip"), text.strip_fences(F.col("t"), "keep")).first()
    assert got[0] == "a\n[javascript code block removed]\nb [code block removed]" and got[1] == "a\n\nb " and got[2].startswith("a\n```JS")
    cut = spark.createDataFrame([("aaa bbb ccc ddd",), ("aaaaaaaaaaaaaaaaaaaa b",), ("short",)], "t string")
    assert [r[0] for r in cut.select(text.snippet(F.col("t"), 12)).collect()] == ["aaa bbb ccc...", "aaaaaaaaaaaa...", "short"]
    assert [r[0] for r in spark.createDataFrame([("<a\nplain\nimport x",), ("<b>",), ("fine",)], "t string").select(text.safe_lines(F.col("t"))).collect()] == ["plain", "[content could not be processed safely]", "fine"]


def test_modes(spark):
    page = "# T\n<Box>x</Box>\n```mermaid\ngraph TD\nA --> B\n```\n```py\n1\n```"
    got = spark.createDataFrame([(page,)], "t string").select(*[markup.preprocess(F.col("t"), F.lit("mdx"), m).alias(m) for m in markup.MODES]).first()
    assert got["strict"].strip() == "# T" and "[diagram removed]" in got["balanced"] and "[component removed]" in got["balanced"] and "A leads to B" in got["rich"] and "<Box>" in got["rich"]
