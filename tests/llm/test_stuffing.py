"""Stuffed pages among prose, data and chats."""

import random

import numpy as np

from ledgerloom.llm.stuffing import CODE, FUNCTION_WORDS, Lexicon, Reading, page_scores, stuffed_pages, tokenise

SUBJECTS = ["The old wallet", "One of the holders", "A group of nine accounts", "The treasury", "Our desk", "A patient seller"]
VERBS = ["moved most of its balance to a new address", "was quiet for the rest of the week", "did not sell into the rally", "has split the position between five accounts", "would rather wait for the next unlock"]
ENDS = ["because the pool was nearly empty.", "and nobody in the chat noticed.", "while the price barely reacted to the news.", "so we keep it on the list for now.", "but the evidence is thin at this point."]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}"


def corpus(seed=1):
    rng = random.Random(seed)
    good = [" ".join(sentence(rng) for _ in range(rng.randint(3, 9))) for _ in range(300)]
    phrases = ["buy morex", "best morex wallet", "cheap morex presale", "morex airdrop code", "top morex holders", "morex staking"]
    links = "\n".join(f"[{rng.choice(phrases)}](https://site{i}.example/p/{i})" for i in range(30))
    bad = [
        ", ".join(rng.choice(phrases) for _ in range(60)), " ".join("#" + rng.choice(phrases).title().replace(" ", "") for _ in range(50)), links, "morex presale\n" * 60,
        " | ".join(f"ledger case {rng.choice(['red', 'blue'])} {rng.choice(['in stock', 'free shipping', 'SKU-12'])}" for _ in range(50)),
        " ".join("Our morex wallet page about morex wallet explains morex wallet and morex code for every morex wallet fan." for _ in range(12)),
        " ★ ".join(" ".join(rng.choice(phrases)) for _ in range(40)), sentence(rng) + "\n" + ", ".join(rng.choice(phrases) for _ in range(60)),
    ]
    data = ["\n".join(f"{i},{rng.random():.4f},{rng.randrange(10**6)}" for i in range(40)), "book: " + ", ".join(f"TOK{i} {rng.random():.2f}" for i in range(40)),
            '{\n' + ",\n".join(f'  "lot_{i}": {rng.random():.3f}' for i in range(30)) + "\n}", "\n".join(f"[1{i}:20] mira: {sentence(rng)}\nzinc: gm" for i in range(9)),
            " ".join(sentence(rng) for _ in range(8)) + "\nSources:\nhttps://a.example/1\nhttps://b.example/2\n#weekly #notes"]
    return good, bad, data


def flagged(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, 0.5, 1) for i, t in enumerate(texts)], "doc_id long, text string, odd_share double, code int")
    return {r.doc_id for r in stuffed_pages(df, **kw).collect()}


def test_finds_stuffed_pages_and_nothing_else(spark):
    good, bad, data = corpus()
    texts = [*good, *data, *bad, bad[0], None, "", "  \n ", "x", "नमस्ते " * 40]  # of the last one's script there is no prose to learn from
    first = len(good) + len(data)
    assert flagged(spark, texts) == set(range(first, first + len(bad) + 1))


def test_short_pages_are_judged_by_evidence(spark):
    good, _, _ = corpus(3)
    links = [f"https://site{i}.example/p/{i}" for i in range(12)]
    bad = ["\n".join(links), " | ".join(links), " ".join(f"#Morex{w}" for w in ("Wallet", "Presale", "Code", "Airdrop", "Staking", "Holders")),
           "buy morex, best morex wallet, cheap morex presale, morex airdrop code, top morex holders", "morex " * 12]
    fine = ["https://site1.example/p/1", "gm gm gm", "Free morex always costs somebody.", "ß", '{\n  "lot_1": 0.2,\n  "lot_2": 314210710\n}\nFree morex always costs somebody.']
    texts = [*good, *fine, *bad]
    first = len(good) + len(fine)
    assert flagged(spark, texts) == set(range(first, first + len(bad)))


def test_no_prose_no_rows_and_long_texts(spark):
    good, bad, _ = corpus(2)
    assert flagged(spark, []) == set() and flagged(spark, [None, ""]) == set()
    long = " ".join(good) * 3
    assert flagged(spark, [*good, long, bad[0] * 200]) == {len(good) + 1}
    scores = page_scores(spark.createDataFrame([(i, t) for i, t in enumerate(good[:5])], "doc_id long, text string")).collect()
    assert len(scores) == 5 and all(r.odd_share < 0.1 for r in scores)


RUSSIAN = [
    ["старый кошелёк", "новый держатель", "крупный продавец", "этот адрес", "тихий участник", "первый покупатель"], ["снова продал", "вчера перевёл", "почти не трогал", "давно держит", "сегодня купил"],
    ["часть запаса на новый адрес", "остаток в том же пуле", "токены с прошлой недели", "монеты из казны", "долю после запуска"], ["и цена не изменилась", "но в чате этого не заметили", "а пул остался пустым", "и мы проверим это завтра"],
]
GREEK = [["το παλιό πορτοφόλι", "ο νέος κάτοχος", "η ομάδα", "ο μεγάλος πωλητής"], ["έστειλε", "πούλησε", "κράτησε", "μοίρασε"], ["τα νομίσματα σε άλλη διεύθυνση", "το μισό από το απόθεμα", "το υπόλοιπο για την επόμενη εβδομάδα", "ένα μέρος στην αγορά"], ["και η τιμή δεν άλλαξε", "αλλά κανείς δεν το είδε", "και το ταμείο έμεινε άδειο"]]


def test_other_scripts_are_learned(spark):
    rng = random.Random(4)
    said = lambda parts: " ".join(rng.choice(p) for p in parts) + "."
    good = [" ".join(said(parts) for _ in range(rng.randint(3, 8))) for parts in (RUSSIAN, GREEK) for _ in range(80)]
    keys = {"ru": ["купить мореко", "бесплатный аирдроп мореко", "лучшая биржа", "дешёвый стейкинг", "бонус код", "скачать приложение"], "el": ["αγορά μορεκο", "δωρεάν μορεκο", "καλύτερο ανταλλακτήριο", "φθηνό στοίχημα", "κωδικός μπόνους"]}
    bad = [sep.join(rng.choice(k) for _ in range(40)) for k in keys.values() for sep in (", ", " | ", "\n")]
    unknown = ["नमस्ते दुनिया । " * 5]  # a script without enough prose to learn from
    texts = [*good, *unknown, *bad]
    first = len(good) + 1
    assert flagged(spark, texts) == set(range(first, first + len(bad)))


def test_prose_of_unseen_words_is_prose(spark):
    """Sentences whose words, function words besides, occur nowhere else."""
    good, bad, _ = corpus(6)
    prose = [
        "She told him that her sister could have left the garden before they came, and then he showed me his new boat.",
        "Can you help us with this? There are more things than we thought, and your brother has not said what he will do with them.",
        "If they had asked me, I would never have sold the farm to those people; nobody knew where it would lead us.",
        "Elle a dit à son frère que la maison était vide et que les enfants sont partis en été avec leur tante.",
        "Er hatte sich schon gefragt, ob die Nachbarn noch da sind, weil sie ihn nicht gegrüßt haben.",
        "No es que la abuela no quiera venir, sino que a su edad un viaje así es más largo de lo que parece.",
    ]
    texts = [*good, *[" ".join([p] * 1 + [q]) for p in prose[:3] for q in prose[:3]], *prose, *bad]
    first = len(texts) - len(bad)
    assert flagged(spark, texts) == set(range(first, len(texts)))


def read(texts):
    return Reading(*tokenise(texts), Lexicon(FUNCTION_WORDS, {}))


def test_symbols():
    r = read(["The bank buys a Bank #tag https://x.y", "", None, "bоnus bonus b0nus 12.5"])
    names = {v: k for k, v in CODE.items()}
    assert [names[c] for c in r.symbol if c] == ["determiner", "new", "new", "determiner", "Soon", "tag", "link", "new", "soon", "soon", "number", "end", "number"]
    assert r.first.sum() == 4 and r.owner.max() == 3 and len(r.chars) == len(r.symbol)
    # A line's start forgets what was before it.
    assert read(["It is\nnew"]).trigrams()[-1] == read(["new"]).trigrams()[-1]
    assert read([]).symbol.size == 0 and read([None, ""]).word.sum() == 0


def test_tokens():
    codes, tokens, sizes = tokenise(["a_b c…d #x, e@f 5.5 www.a.b/c) HTTPS://d", "", "日本 x"])
    got = [tokens[c] for c in codes]
    assert got == ["\n", "a_b", "c…d".replace("…", "."), *got[3:]] or got[1] == "a_b"
    assert [t for t in got if t != "\n"][-6:] == ["www.a.b/c", ")", "HTTPS://d", "日", "本", "x"] and list(sizes) == [len(got) - 5, 1, 4]
