"""Small corpora given as facts."""

from factweave.plans.corpus import Corpus

#: Pages: path, facts in feed order.
PAGES = [
    (0, "http://bank.example/login", ["field[]=username", "field[]=password", "formaction[]=evil.example", "formhost[]=evil.example", "resource[]=cdn.example", "shape[]=aa11", "title[]=Bank"]),
    (1, "http://bank2.example/login", ["field[]=username", "field[]=password", "formaction[]=evil.example", "formhost[]=evil.example", "resource[]=cdn.example", "shape[]=aa11", "title[]=Bank"]),
    (2, "http://bank3.example/in", ["field[]=username", "field[]=password", "formaction[]=evil.example", "formhost[]=evil.example", "resource[]=cdn.example", "shape[]=aa11", "title[]=Other"]),
    (3, "http://shop.example/pay", ["field[]=card_no", "field[]=cvv", "formhost[]=shop.example", "title[]=Pay", "shape[]=cc33"]),
    (4, "http://find.example/", ["field[]=q", "formhost[]=find.example", "title[]=Search", "shape[]=dd44"]),
    (5, "http://mail.example/", ["field[]=email", "title[]=Mail", "shape[]=ee55"]),
    (6, "http://news.example/", ["title[]=News", "resource[]=img.example", "shape[]=ff66"]),
    (7, "http://blog.example/", ["title[]=Blog", "resource[]=blog.example", "shape[]=ab77"]),
    (8, "HTTP://Upper.example/in", ["field[]=pwd", "formhost[]=other.example", "title[]=Upper", "shape[]=ba88"]),
    (9, "saved/page.html", ["field[]=pwd2", "formhost[]=other2.example", "title[]=Saved", "shape[]=ca99"]),
    *[(10 + i, f"https://look{i}.example/", ["meta[]=generator=K", "heading[]=h1:Same", "path[]=html>body", "shape[]=da10", f"title[]=Look{i}"]) for i in range(2)],
    *[(12 + i, f"https://pay{i}.example/", ["field[]=otp", "field[]=iban", "formfields[]=f0f0", "resource[]=kit.example", f"title[]=Pay{i}"]) for i in range(2)],
]
#: Binaries: path and facts; two families of three and four others.
BINARIES = [
    *[(i, f"good{i}.bin", ["binary.format=elf/x86_64", "imports[]=malloc", f"strings[]=own{i}"]) for i in range(4)],
    *[(i, f"bad{i}.bin", ["binary.format=elf/x86_64", "imports[]=malloc", "imports[]=ptrace", "needs[]=libevil.so", "strings[]=c2.example", f"strings[]=own{i}"]) for i in range(4, 7)],
    *[(i, f"worm{i}.bin", ["binary.format=elf/x86_64", "exports[]=spread", "sections[]=.worm", f"strings[]=own{i}"]) for i in range(7, 10)],
]


def inline(spark, rows):
    arts = spark.createDataFrame([(i, p, "html", 0) for i, p, _ in rows], "artifact_id long, path string, kind string, size long")
    facts = spark.createDataFrame([(i, n, "kv", c, 0) for i, _, cs in rows for n, c in enumerate(cs)], "artifact_id long, ord int, kind string, canonical string, line int")
    return Corpus(arts, facts)
