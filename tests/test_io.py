"""Reference file formats: Latin-1 lexicon, id<TAB>text lines, message CSV."""
import glob
import gzip
import os

from authornet.sources import sinks
from authornet.sources.tables import read_lexicon_dic, read_messages


def test_read_latin1_dic(spark, tmp_path):
    p = tmp_path / "lex.dic"
    p.write_bytes("%\n1\tPronoun\n2\tI\n12\tAffect\n%\nich\t2\t1\nmüde*\t12\nGrüße\t12\n".encode("latin-1"))
    rows = {r.word: r.categories for r in read_lexicon_dic(spark, str(p)).collect()}
    assert rows == {"ich": [2, 1], "müde*": [12], "Grüße": [12]}


def test_write_id_text_unquoted(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", ok'), (2, None), (3, "")], "UID_key long, final_message_string string")
    out = str(tmp_path / "ids")
    sinks.write_id_text(df, out)
    lines = sorted(l for f in glob.glob(os.path.join(out, "part-*")) for l in open(f, encoding="utf-8").read().splitlines())
    assert lines == ["1\tsay \"hi\", ok", "2\t", "3\t"]


def test_read_message_csv_with_quotes_and_newlines(spark, tmp_path):
    p = tmp_path / "m.csv.gzip"
    body = ('"",UID_key,author,message,fwd_message,fwd_author,date,transcribed_message,group_or_channel,group_name\n'
            '0,1,A,"a ""quoted"", multi\nline text",,,2021-01-05,,group,g1\n'
            '1,2,B,,fw,A,2021-01-06,spoken,channel,g2\n')
    with gzip.open(p, "wt", encoding="utf-8") as f:
        f.write(body)
    rows = {r.UID_key: r for r in read_messages(spark, str(p)).collect()}
    assert rows[1].message == 'a "quoted", multi\nline text'
    assert rows[2].fwd_author == "A" and rows[2].transcribed_message == "spoken"
    assert str(rows[1].date) == "2021-01-05"
