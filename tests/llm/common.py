"""Small tables with the cases that every operator must handle, and brute-force helpers."""

import os
import re

import public_tokenizers

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
SF_SMALL = "/root/testdata/sf0.001"

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " \
       "phi chi psi omega one two three four five six seven eight nine ten eleven twelve"
CASES = [
    (1, BASE), (2, BASE), (3, BASE.upper()), (4, BASE.replace("omega", "OMEGA!")), (5, None), (6, ""), (7, " \n\t "),
    (8, "three words only"), (9, "Three  words\nonly"), (10, "naïve café, l'été — it's 12x “quoted” ﬁ é 中文 🙂"),
    (11, "a<|endoftext|>b <|startoftext|> <s> </s> ▁x ▁ y"), (12, "x" * 5000), (13, (BASE + ".\n") * 300),
    (14, "tab\tand\r\nbreaks\x0b\x0c     end "), (15, "control \x1c\x1d chars \x00 here"), (None, "no id here"),
    (None, BASE), (2, BASE), (16, "İstanbul ΑΣ ß ŉ"), (17, "  lead and trail  "), (18, "don't we'll I'm THEY'RE"),
]


def docs(spark, rows=CASES):
    """documents with further columns, some of them named as operators name theirs."""
    return spark.createDataFrame(
        [(i, t, "en", "src0", len(t or ""), "clash", 7, b"k") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, id string, n long, node binary")


def words(text):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]


def shingles(text):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset({tuple(w)}) if len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components(ids, linked):
    """id -> smallest id reachable over the pairs."""
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in linked:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_components(texts):
    """Brute-force components at 100 * intersection >= 85 * union."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
             if 100 * (c := len(sets[a] & sets[b])) >= 85 * (len(sets[a]) + len(sets[b]) - c)]
    return components(list(texts), pairs), sets


def small_table(name):
    import duckdb
    return duckdb.sql(f"select * from '{os.path.join(SF_SMALL, name)}.parquet'").fetchall()


def run_oracle(sql, tables):
    """Rows of a DuckDB statement over {name: list of tuples with a first tuple of column definitions}."""
    import duckdb
    con = duckdb.connect()
    for name, (columns, rows) in tables.items():
        con.execute(f"create table {name} ({columns})")
        if rows:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
    q = con.execute(sql)
    return [d[0] for d in q.description], q.fetchall()
