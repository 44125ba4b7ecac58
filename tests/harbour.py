"""A small pair as files: ships, ports and countries, some of them apart from the rest."""

DATE = "<http://www.w3.org/2001/XMLSchema#date>"
FILES = {
    "rel_triples_1": ["l/anna\tsailsTo\tl/oslo", "l/bert\tsailsTo\tl/oslo", "l/anna\tsisterOf\tl/bert", "l/oslo\tpartOf\tl/norway", "l/carl\tsailsTo\tl/riga"],
    "rel_triples_2": ["r/Anna\tgoesTo\tr/Oslo", "r/Bert\tgoesTo\tr/Oslo", "r/Bert\tsiblingOf\tr/Anna", "r/Norway\tcontains\tr/Oslo", "r/Riga\tnextTo\tr/Norway"],
    "attr_triples_1": ['l/anna\tname\t"Anna of Bergen"', f'l/anna\tbuilt\t"1921-05-06"^^{DATE}', 'l/bert\tname\t"Bert"', 'l/oslo\tpeople\t"709000"', 'l/riga\tname\t"Rīga"@lv'],
    "attr_triples_2": ['r/Anna\tlabel\t"ANNA of Bergen"', 'r/Anna\tlaunched\t"1921-05-06"^^xsd:date', 'r/Oslo\tpopulation\t"709000"', 'r/Riga\tlabel\t"riga"@en'],
    "ent_links": ["l/anna\tr/Anna", "l/bert\tr/Bert", "l/oslo\tr/Oslo", "l/norway\tr/Norway", "l/riga\tr/Riga", "l/ghost\tr/Phantom"],
    "721_5fold/1/train_links": ["l/anna\tr/Anna", "l/oslo\tr/Oslo"],
    "721_5fold/1/valid_links": ["l/bert\tr/Bert"],
    "721_5fold/1/test_links": ["l/norway\tr/Norway", "l/riga\tr/Riga", "l/ghost\tr/Phantom"],
    "721_5fold/2/train_links": ["l/bert\tr/Bert", "l/norway\tr/Norway", "l/ghost\tr/Phantom"],
    "721_5fold/2/valid_links": ["l/oslo\tr/Oslo"],
    "721_5fold/2/test_links": ["l/anna\tr/Anna", "l/riga\tr/Riga"],
}


def write(root) -> str:
    for name, lines in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(root)
