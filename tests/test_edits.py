import hashlib
import os

import pytest

from inkspark.sinks import edits, packages, pdf as sink
from inkspark.sources import aes, cos, docx, pdf
from inkspark.sources.package import FormatError

name, ref = cos.Name, cos.Ref


def test_revisions_are_settled():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = (
        f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:jc w:val="left"/><w:pPrChange w:id="9"><w:pPr><w:jc w:val="right"/></w:pPr></w:pPrChange></w:pPr><w:r><w:t>a</w:t></w:r>'
        "<w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p><w:ins><w:p><w:r><w:t>more</w:t></w:r></w:p></w:ins></w:body></w:document>"
    )
    data = packages.zip_bytes([("word/document.xml", body.encode()), ("word/other.bin", b"\0raw")])
    yes, no = edits.settle_revisions(data), edits.settle_revisions(data, "reject")
    assert docx.flat_text(yes, "reject") == docx.flat_text(yes) == docx.flat_text(data) == "anew\nmore"
    assert docx.flat_text(no) == docx.flat_text(data, "reject") == "aold"
    assert docx.parse(yes)["paragraphs"][0][3] == "left" and docx.parse(no)["paragraphs"][0][3] == "right"
    assert ("word/other.bin", b"\0raw") in docx.parse(yes)["raw_parts"]


def form() -> bytes:
    on = lambda s: {"N": {s: None, "Off": None}}
    return sink.build({
        1: {"Type": name("Catalog"), "Pages": ref(2, 0), "AcroForm": {"Fields": [ref(4, 0), ref(5, 0), ref(6, 0), ref(7, 0), ref(10, 0)]}}, 2: {"Type": name("Pages"), "Kids": [ref(3, 0)], "Count": 1}, 3: {"Type": name("Page"), "Parent": ref(2, 0)},
        4: {"T": b"text", "FT": name("Tx"), "MaxLen": 5}, 5: {"T": b"box", "FT": name("Btn"), "AP": on("On")}, 6: {"T": b"pick", "FT": name("Ch"), "Opt": [[b"1", b"one"], b"two"]},
        7: {"T": b"radio", "FT": name("Btn"), "Ff": 1 << 15, "Kids": [ref(8, 0), ref(9, 0)]}, 8: {"AP": on("A")}, 9: {"AP": on("B")}, 10: {"T": b"fixed", "FT": name("Tx"), "Ff": 1},
    }, {"Root": ref(1, 0)})


def test_forms_are_filled():
    done = edits.fill(form(), {"text": "längere", "box": True, "pick": "one", "radio": "B"})
    assert {f[1]: f[3] for f in pdf.parse(done)["fields"]} == {"text": "länge", "box": "On", "pick": "1", "radio": "B", "fixed": None}
    doc = cos.Document.open(done)
    assert [str(doc.resolve(ref(k, 0))["AS"]) for k in (5, 8, 9)] == ["On", "Off", "B"] and done.startswith(form())
    for bad in ({"nope": "x"}, {"fixed": "x"}, {"pick": "three"}, {"radio": "C"}):
        with pytest.raises(FormatError):
            edits.fill(form(), bad)


def choices() -> bytes:
    return sink.build({
        1: {"Type": name("Catalog"), "Pages": ref(2, 0), "AcroForm": {"Fields": [ref(k, 0) for k in range(4, 10)]}}, 2: {"Type": name("Pages"), "Kids": [ref(3, 0)], "Count": 1}, 3: {"Type": name("Page"), "Parent": ref(2, 0)},
        4: {"T": b"many", "FT": name("Ch"), "Ff": 1 << 21, "Opt": [[b"k", b"kiwi"], b"fig", [b"p", b"plum"]], "DV": [b"p", b"fig"]}, 5: {"T": b"one", "FT": name("Ch"), "Ff": 1 << 17, "Opt": [b"x", b"y"]},
        6: {"T": b"note", "FT": name("Tx"), "V": b"now", "DV": b"then"}, 7: {"T": b"tick", "FT": name("Btn"), "V": name("Yes"), "AP": {"N": {"Yes": None, "Off": None}}},
        8: {"T": b"shut", "FT": name("Tx"), "Ff": 1, "V": b"kept", "DV": b"other"}, 9: {"T": b"bad", "FT": name("Btn"), "Ff": 1 << 16},
    }, {"Root": ref(1, 0)})


def test_choices_are_selected():
    node = lambda data, k: cos.Document.open(data).resolve(ref(k, 0))
    done = node(edits.choose(choices(), "many", ["plum", "k", "p"]), 4)
    assert (done["V"], done["I"]) == ([b"k", b"p"], [0, 2])
    done = node(edits.choose(choices(), "many", ["fig"]), 4)
    assert done["V"] == b"fig" and done.get("I") is None and node(edits.choose(choices(), "many", []), 4).get("V") is None
    for field, wanted in (("many", ["pear"]), ("one", ["x", "y"]), ("note", ["x"]), ("nope", []), ("shut", [])):
        with pytest.raises(FormatError):
            edits.choose(choices(), field, wanted)


def test_fields_are_reset():
    data = edits.choose(edits.fill(choices(), {"one": "y"}), "many", ["kiwi"])
    done = cos.Document.open(edits.reset(data))
    node = lambda k: done.resolve(ref(k, 0))
    assert (node(4)["V"], node(4)["I"]) == ([b"p", b"fig"], [1, 2]) and node(5).get("V") is None and node(6)["V"] == b"then"
    assert node(7).get("V") is None and str(node(7)["AS"]) == "Off" and node(8)["V"] == b"kept"
    assert cos.Document.open(edits.reset(data, ["note"])).resolve(ref(5, 0))["V"] == b"y"
    for named in ("shut", "bad", "nope"):
        with pytest.raises(FormatError):
            edits.reset(data, [named])


def test_attachments_are_embedded():
    data = edits.attach(form(), [("z.txt", b"zz", "last"), ("ä.json", b"{}", "")])
    assert [(a[2], a[4], a[6]) for a in pdf.parse(data)["attachments"]] == [("z.txt", "text/plain", b"zz"), ("ä.json", "application/json", b"{}")]
    with pytest.raises(FormatError):
        edits.attach(data, [("z.txt", b"", "")])


def test_aes():
    key, plain = bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert aes.encrypt(key, plain, bytes(16)).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert aes.encrypt(bytes(range(32)), plain, bytes(16)).hex() == "8ea2b7ca516745bfeafc49904b496089"
    sealed = aes.encrypt(key, plain * 2, key)
    assert aes.decrypt(key, sealed, key, padded=False) == plain * 2


def sealed_file(version: int, password: bytes) -> bytes:
    """A file whose one string and stream are encrypted."""
    pad = cos._PAD
    content = b"BT /F1 10 Tf 10 10 Td (secret) Tj ET"
    if version == 5:
        key = os.urandom(32)
        u_salt, k_salt = b"saltsalt", b"keysalt!"
        u = cos._hash_6(password, u_salt, b"") + u_salt + k_salt
        ue = aes.encrypt(cos._hash_6(password, k_salt, b""), key, bytes(16))
        e = {"Filter": name("Standard"), "V": 5, "R": 6, "O": bytes(48), "OE": bytes(32), "U": u, "UE": ue, "P": -4, "CF": {"StdCF": {"CFM": name("AESV3")}}, "StmF": name("StdCF"), "StrF": name("StdCF")}
        seal = lambda num, raw: bytes(16) + aes.encrypt(key, raw + bytes([16 - len(raw) % 16]) * (16 - len(raw) % 16), bytes(16))
    else:
        o = bytes(32)
        key = hashlib.md5((password + pad)[:32] + o + b"\xfc\xff\xff\xff" + b"id").digest()
        for _ in range(50):
            key = hashlib.md5(key).digest()
        u = cos._rc4(key, hashlib.md5(pad + b"id").digest())
        for k in range(1, 20):
            u = cos._rc4(bytes(c ^ k for c in key), u)
        e = {"Filter": name("Standard"), "V": 4, "R": 4, "Length": 128, "O": o, "U": u + bytes(16), "P": -4, "CF": {"StdCF": {"CFM": name("AESV2")}}, "StmF": name("StdCF"), "StrF": name("StdCF")}

        def seal(num, raw):
            own = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0sAlT").digest()
            return bytes(16) + aes.encrypt(own, raw + bytes([16 - len(raw) % 16]) * (16 - len(raw) % 16), bytes(16))

    return sink.build({
        1: {"Type": name("Catalog"), "Pages": ref(2, 0)}, 2: {"Type": name("Pages"), "Kids": [ref(3, 0)], "Count": 1},
        3: {"Type": name("Page"), "Parent": ref(2, 0), "Contents": ref(4, 0), "Resources": {"Font": {"F1": {"Type": name("Font"), "Subtype": name("Type1"), "BaseFont": name("Helvetica")}}}},
        4: cos.Stream({}, seal(4, content)), 5: {"Title": seal(5, b"Hidden")}, 6: e,
    }, {"Root": ref(1, 0), "Info": ref(5, 0), "Encrypt": ref(6, 0), "ID": [b"id", b"id"]})


@pytest.mark.parametrize("version", [4, 5])
def test_encrypted_files_open(version):
    data = sealed_file(version, b"pw")
    t = pdf.parse(data, "pw")
    assert t["runs"][0][2] == "secret" and t["documents"][0][5] == "Hidden" and t["documents"][0][2]
    with pytest.raises(FormatError, match="password"):
        pdf.parse(data, "other")
    with pytest.raises(FormatError):
        edits.fill(data, {})
