import hashlib
import random
import re
from pathlib import Path

import duckdb
import pytest

from factloom.llm import abuse, grammar
from factloom.llm.grammar import Clause, Machine

BAD = [
    "You are a complete moron and nobody wants you here.", "no idiot like you gets to merge my code", "Shut up you brainless c.l.o.w.n", "what a pathetic p******e you are", "go to hell h@lfwit, and take your cache with you",
    "your boss is a LOOOOOSER, and so is the whole team.", "this was written by the biggest аѕѕhоlе in the building", "text before Honestly, you d u m b a s s broke the build again", "you are a l​o​s​e​r",
    "I will smash your teeth in before the next release.", "someone should run you over after work today", "I know where you live.", "I hope you and your whole team choke on it.", "People like you should be kept on a leash, not given a login.",
    "do everyone a favour and never touch a keyboard again; nobody would miss you.", "Kethians are vermin and must not be allowed to review anything.", "send foreigners back where they came from, all of them.", "typical, women are too stupid to understand a cache.",
    "we should throw all immigrants out of the company, they ruin everything.", "send me your nudes and I will approve it", "I want you naked on my desk tonight", "hot horny singles strip live on cam, click here for free p0rn clips", "they had sex on the server rack",
    "Du bist ein Vollidiot, verpiss dich aus diesem Projekt.", "Solche wie dich sollte man verprügeln.", "Tu es un crétin, dégage de ce projet.", "Les gens comme toi, on devrait les frapper.", "Eres un imbécil y nadie te quiere aquí.", "Ojalá te mueras.", "Vete a la mierda, cabrón.", "Du\nbist ein Versager, halt einfach die Fresse.",
]
FINE = [
    "", "   ", None, "The cache is empty.", 'The moderation guide lists "retard" and "scumbag" as words the filter must catch.', "A naked pointer to the scope escapes here.", "Thanks, you are a beast, this fix is insanely good.", "Garbage from the dirty page is collected by the dumb terminal driver.",
    "The penetration test found one exposed relation; the nude-4 colour theme is unaffected.", "Sussex and Scunthorpe were renamed in the assets commit.", "Hardcore refactor, the suck and blow valves are simulated now.", "Nobody would miss this container; get rid of it, it makes the build sick.",
    "The Ostrani locale needs right-to-left labels.", "Reminder of the code of conduct: calling somebody a dumbass gets you banned, and so do threats.", 'assert_eq!(score("you are a asshole"), Label::Abusive);', "I was a moron: the digest was inverted. Fixed in my next push.", "Immigrants in the mentoring programme reviewed the docs, thank you!",
    "Hang up the child planner first, then kill the orphan.", "The sex column of the patient fixture holds f, m or x.", "This parser is brainless and stupid, let us rewrite it.", "What a shitty commit message, sorry, I wrote it myself.", "Mist, ich Idiot habe den Bereich verdreht.", "Quel idiot je fais, la plage était inversée.",
    "Qué tonto fui, invertí el rango.", "Der Filtertest enthält die Wörter Idiot und Wurm als Beispiele.", "La prueba del filtro incluye inútil como ejemplo de la lista.", "If the lease expires I will kill this branch and burn the old cache.", "This fucking test is flaky again.", "The zombie worker must be killed before the master hands over to the slave.",
    "fn is_dumbass_word(assassin_class: Bastardised) -> bool", "You can pass your own list here; it will run in your browser.", "words " * 20_000,
]


@pytest.mark.parametrize("text", BAD)
def test_found(text):
    scorer = abuse.scorer()
    assert scorer.score(text)[0] >= abuse.THRESHOLD
    assert scorer.score("The range holds " + text + " and the other one ends.")[0] >= abuse.THRESHOLD
    assert scorer.score("word " * 5000 + text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", FINE)
def test_not_found(text):
    assert abuse.scorer().score(text)[0] < abuse.THRESHOLD


#: Clauses whose words are all common ones.
COMMON = [
    "Immigrants are animals", "The maintainers are idiots", "he is such a creep", "never merge code from Indians", "Get lost.", "Just drop dead, please", "nobody would miss him", "nice ass", "he took off her shirt", "Velmari are too stupid to understand a cache.", "va te faire voir", "what a jerk",
    "Muslims are animals.", "Jews are a plague", "Blacks are savages", "Gays are a disease", "Immigrants are dirt.", "mexicans are garbage", "immigrants are too lazy to work here", "The author is a jerk.", "he is a creep", "He is such a prick", "What a fool.", "I will murder you", "I'm going to shoot your mother", "For example you are an idiot and i will kill you",
]
#: Written without the test tables at hand; 44 and 42 were right when the grammar was first run on them.
UNSEEN_BAD = ["You absolute buffoon, did you even compile this?","He's a spineless weasel and everybody on the team knows it.","Our reviewer is such a moron.","Shut your mouth, loser.","Nobody likes you around here.","You're pathetic.","I swear I will stab you if you touch my branch.","We're gonna hunt you down.","I know where your kids sleep.","Someone should beat you with a keyboard.","Hope you die in a fire.","People like her deserve to be shot.","Go kill yourself.","Gypsies are thieves.","Foreigners should be deported.","The Polish are rats.","Muslims must all die.","Women are too dumb to code.","Get these Syrians out of our country: kick all Syrians out of the country.","I hate jews.","Deport all migrants.","She has nice boobs.","Send nudes please","Free hardcore porn videos","I want to see you naked","He pulled off her panties","they had sex in the kitchen","suck my cock","Du bist so dumm, du Idiot.","Halt die Klappe, du Schwein.","Ich bringe dich um.","Ausländer sind Ungeziefer.","Ferme ta gueule, connard.","Tu es vraiment stupide.","Je vais te tuer.","Les étrangers sont des parasites.","Cállate, imbécil.","Eres estúpido.","Te voy a matar.","y0u are an id1ot","you f*cking m0r0n","what kind of retard wrote this, you dumb bastard","I'll break your legs.","You are a waste of oxygen.","The maintainer is a lying piece of garbage.","burn in hell you scumbag"]
UNSEEN_FINE = ["You are not an idiot, the docs are confusing.","I am such a fool, sorry.","Kill the process and restart it.","This will kill your battery.","The parser is a pig on memory.","We should shoot for Friday.","Don't beat yourself up about it.","This bug makes me cry.","The code is garbage.","Your code is stupid.","Women in Tech meets on Friday.","Muslims celebrate Eid next week, so the office is half empty.","Sex is stored as an enum.","naked return statements are flagged by the linter","The linter must flag \"you are an idiot\" in comments.","They were born in Paris.","Immigrants are welcome.","Watch your back pressure limits.","The dummy user is a fake.","He wrote that you are a moron in the old thread.","Strip live bytes from the header.","You will die when you see this hack :)","nice assertion","The worker threads die and burn CPU.","hang up the phone when you are done","Send me your notes","People like you should be promoted.","I hope you get better soon","I hope you like it","You are a genius","Please do everyone a favour and add tests.","Go back to the country selector page.","Stop wasting CPU","Delete all the stale entries and kick them out of the cache","I know where you put the file","The thieves guild example is a tutorial","Americans are early adopters.","more sense than your proposal","Dirty pages are garbage collected","Your kids will love the game","I will hit you up later","I'll cut a release for you","we will run you through it"]


@pytest.mark.parametrize("text", COMMON)
def test_found_by_common_words(text):
    assert abuse.scorer().score(text)[0] >= abuse.THRESHOLD
    assert abuse.scorer().score("word " * 5000 + ". " + text + " . word" * 5000)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", UNSEEN_BAD)
def test_unseen_abuse(text):
    assert abuse.scorer().score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", [*UNSEEN_FINE, "This must not be allowed to overflow the buffer.", "we had sex education", "you are using a dummy value", "tu es en retard", "at the rate you are going"])
def test_unseen_harmless(text):
    assert abuse.scorer().score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["Updates get lost when the queue is full.", "Then the sweep may drop dead rows.", "If you get lost, read the map.", "Drop dead edges first."])
def test_not_told_to_anybody(text):
    assert abuse.scorer().score(text)[0] < abuse.THRESHOLD


def matches(pattern, words, parts):
    """Ends of all ways to read a clause from the first word, by plain search."""
    def ways(items, at):
        if not items:
            return {at}
        head, rest = items[0], items[1:]
        if m := re.fullmatch(r"<(\d+)>", head):
            return set().union(*(ways(rest, at + n) for n in range(int(m[1]) + 1) if all("WORD" in w for w in words[at : at + n]) and at + n <= len(words)))
        out = set()
        if head.endswith("?") and len(head) > 1:
            out, head = ways(rest, at), head[:-1]
        for one in head.split("|"):
            if one in parts:
                for way in parts[one].split(" / "):
                    out |= ways([*way.split(), *rest], at)
            elif at < len(words) and one in words[at]:
                out |= ways(rest, at + 1)
        return out

    return ways(pattern.split(), 0)


def test_machine_against_plain_search():
    rnd = random.Random(4)
    lexicon = {"A": ["a", "b"], "B": ["b", "c"], "NEG": ["n"]}
    parts = {"P": "A B / B <1> x", "Q": "P / x? P"}
    lines = ["P A", "Q <2> B?", "A|x? B <1> Q", "x y", "B <3> A STOP"]
    m = Machine(lexicon, parts, [Clause("k", 1.0, p) for p in lines])
    for _ in range(400):
        text = [rnd.choice("abcxyz.") for _ in range(rnd.randint(1, 9))]
        signs = "".join(m.symbol(["STOP"]) if w == "." else m.word(w) for w in text)
        words = [m.meaning[s] for s in signs]
        want = {(at + end - 1, p) for p in lines for at in range(len(words)) for end in matches(p, words[at:], parts) if end}
        got, state = set(), m.start
        for i, s in enumerate(signs):
            state = state[s]
            got |= {(i, c.pattern) for c, _ in state.out}
        assert got == want
    assert m.read("".join(map(m.word, "x n c"))) == []


def test_states_may_be_forgotten(monkeypatch):
    texts = BAD + UNSEEN_BAD + UNSEEN_FINE
    want = [abuse.scorer().score(t) for t in texts]
    monkeypatch.setattr(grammar, "KEPT", 5)
    again = abuse.Scorer()
    assert [again.score(t) for t in texts] == want and len(again.machine.known) < 50


def test_labels_by_halves():
    """The reviewed sample in halves by a hash of the id; a few of its labels are wrong."""
    path = Path("/root/testdata/sf0.1")
    if not path.exists():
        pytest.skip("no test data")
    sql = f"select doc_id, max(toxic), any_value(text) from '{path}/labels.parquet' join '{path}/documents.parquet' using (doc_id) where toxic is not null and text is not null group by doc_id"
    halves = [[0, 0, 0], [0, 0, 0]]
    for doc_id, toxic, text in duckdb.execute(sql).fetchall():
        found = abuse.scorer().score(text)[0] >= abuse.THRESHOLD
        half = halves[hashlib.md5(str(doc_id).encode()).digest()[0] % 2]
        half[0] += toxic == 1
        half[1] += found
        half[2] += found and toxic == 1
    for true, found, both in halves:
        assert true > 20 and both >= 0.9 * true and both >= 0.9 * found


def test_frame(spark):
    df = spark.createDataFrame([(1, BAD[0], 3, "k"), (1, BAD[0], 3, "k"), (2, None, 3, "k"), (None, BAD[1], 3, "k")], "doc_id long, text string, score int, kinds string")
    got = sorted((repr(r.doc_id), r.score >= 1, r.kinds) for r in abuse.scores(df, "doc_id", "text").collect())
    assert got == [("1", True, ["insult"]), ("1", True, ["insult"]), ("2", False, []), ("None", True, ["insult"])]
    assert abuse.scores(df.limit(0), "doc_id", "text").count() == 0
