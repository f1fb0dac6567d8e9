"""Classes of words, machines for the parts of a clause, and weighted clauses of abusive language.

English, German, French and Spanish, in plain spelling (lower case, no accents). The clauses say who
is spoken to or of, what is said, and what context takes it back; no clause is a single word."""

from __future__ import annotations

from factloom.llm.grammar import REPORTED, SELF, Clause


def _forms(words: str, *endings: str) -> list[str]:
    """Words with their endings; an e that a vowel follows and a final y before s give way."""
    out = []
    for w in words.split():
        out.append(w)
        for e in endings:
            stem = w[:-1] if (w[-1] == "e" and e[0] in "ei") or (w[-1] == "y" and e in ("es", "ed")) else w
            out.append(stem + ("i" if w[-1] == "y" and e in ("es", "ed") else "") + e)
    return out


def _plural(words: str) -> list[str]:
    return _forms(words, "s") + [w[:-1] + "ies" if w[-1] == "y" else w + "es" for w in words.split() if w[-1] in "ysxh"]


LEXICON: dict[str, list[str]] = {
    "YOU": "you u ya yourself yourselves du dich dir ihr euch tu toi te vous vos ti os usted ustedes".split(),
    "YOUR": "your ur yours dein deine deinen deiner euer eure ton ta tes votre tus su".split(),
    "HE": "he she him her er sie il elle el ella".split(),
    "BE": "am is are was were be been being bist ist sind seid war es est etes sont eres son sois".split(),
    "NEG": "not never no nobody none hardly isnt kein keine keinen nicht nie pas jamais nunca ni".split() + "en said says told thinks claims you".split(),  # "en retard" is no insult, "he wrote that you are" says nothing of him
    "NOBODY": "nobody noone niemand keiner nadie personne".split(),
    "DET": "a an the such some this that these those all every ein eine einen der die das un une le la les el los una unos des".split(),
    "MUCH": "just really so very such too quite only nothing but always still truly utterly totally completely absolutely fucking damn bloody freaking obviously clearly a an the most more all both echt nur so total vraiment tellement muy tan".split(),
    "LIKE": "like wie comme como".split(),
    "SURE": "look sound act write code talk behave think smell looks sounds".split(),
    # insults for a person
    "INSULT": _plural(
        "asshole arsehole ass bastard bitch blockhead bonehead buffoon clown coward cretin creep cunt degenerate dickhead dimwit dingbat dolt donkey douche douchebag dullard dumbass dumbfuck dumbo dunce"
        " fool freak fuckface fuckhead fuckwit halfwit hypocrite idiot ignoramus imbecile jackass jerk knucklehead liar loser lunatic maggot moron motherfucker muppet nitwit numbskull nutjob parasite pig"
        " pervert prick psychopath rat retard scum scumbag shithead shitbag simpleton skank slob slut sociopath sucker swine thug tosser turd twat twit vermin wanker weasel weirdo whore wimp worm wretch dipshit"
    )
    + (
        "arschloch arschlocher depp deppen drecksack drecksau dummkopf idioten miststuck mistkerl missgeburt nichtsnutz penner schlampe schwachkopf schwein schweine spast trottel versager vollidiot vollidioten vollpfosten wichser wurm hurensohn hure"
        " abruti abrutis abrutie batard connard connards connasse cretins encule enfoire imbeciles minable pute raclure salaud salauds salope"
        " imbecil imbeciles cabron cabrones capullo estupido estupida estupidos gilipollas idiotas idiota inutil inutiles payaso payasos pendejo pendejos subnormal tonto tonta tontos zorra puta maricon mierda escoria basura"
    ).split(),
    #: insults that are common words of another language, told by the words around them
    "INSULT_TOO": "con conne cons rate ratee debile ordure mierda basura merde nul nulle".split(),
    #: what degrades whoever it is said of, and what is only harsh
    "DEGRADING": "brainless braindead disgusting filthy loathsome miserable moronic idiotic pathetic pitiful repulsive revolting spineless stinking stupid vile worthless despicable subhuman retarded dumb dumbest dreckig dreckiger dumm dummer widerlich erbarmlich pauvre sale stupide pathetique asqueroso patetico despreciable".split(),
    "HARSH": "dirty fat ugly lazy lying useless incompetent clueless ignorant shitty crappy lousy greedy criminal violent crazy insane dense thick slow hopeless inferior faul hasslich unfahig laid incapable feo vago sucio".split(),
    "LITTLE": "little old big fat small absolute complete total utter pure fucking damn bloody dumb lazy ugly useless dirty lying shitty piece of pedazo de kleiner kleines petit espece".split(),
    "SUPER": "biggest most worst dumbest greatest largest stupidest laziest ugliest".split(),
    "CREATURE": "creature person human brat insect boy girl man woman freak thing".split(),
    "BEAST": "animal animals cockroach cockroaches degenerates dogs insects leeches liars maggots monkeys apes parasites pigs rats savages scum subhuman subhumans thieves criminals rapists vermin pest lice filth cancer inferior abschaum ungeziefer parasiten vermine parasites escoria ratas".split(),
    "WASTE": "garbage trash dirt disease plague rubbish shit poison dreck abfall ordures basura".split(),
    "DISGRACE": "disgrace embarrassment waste burden abomination failure disappointment nothing nobody".split(),
    "WITS": "brains brain sense intelligence talent dignity class backbone spine iq wit wits manners".split(),
    "PARENT": "mother father mom mum dad family parents wife husband kids children grandmother".split(),
    "ROLE": _plural(
        "author reviewer maintainer boss guy dude girl woman man committer contributor developer coder programmer engineer colleague coworker teammate intern admin moderator ceo director person genius manager lead owner team wife husband mother father brother sister"
    )
    + "whoever who people men women everyone everybody he she they".split(),
    "PERSON": "author reviewer maintainer boss committer contributor intern colleague coworker ceo director moderator guy him her them".split(),
    "GROUP": _plural(
        "immigrant foreigner migrant refugee jew muslim christian hindu black white gay lesbian homosexual transsexual gypsy indian african arab mexican asian american european pole turk russian ukrainian italian pakistani nigerian hispanic latino"
    )
    + "women men girls females blacks chinese japanese vietnamese disabled elderly frauen auslander juden turken schwule fluchtlinge femmes etrangers juifs arabes noirs immigres mujeres extranjeros judios negros moros gitanos inmigrantes".split(),
    "KIND": "old black white brown gay trans disabled poor fat jewish muslim foreign such those these that their your asian african".split(),
    "SLUR": _plural("faggot fag tranny kike spic gook nigger wetback raghead towelhead dyke negro coon beaner"),
    "FOLK": "people peoples folk folks person kind sort lot leute volk gens gente".split(),
    # threats
    "FUTURE": "will shall going should must gonna would want love might ought to werde wollen sollte vais va voy".split(),
    "SPEAKER": "i we someone somebody they he she one".split(),
    "HARM": "kill murder stab strangle rape punch shoot beat slap smash burn drown choke crush slaughter torture behead lynch bash poison skin gut bury whip hang execute butcher hurt cut break slit throttle".split(),
    "HARMED": "killed murdered stabbed strangled raped punched shot beaten slapped burned burnt drowned crushed tortured beheaded lynched hanged hung executed whipped gassed caged jailed locked thrown sterilized castrated neutered chained flogged buried deported exterminated skinned".split(),
    "BODY": "teeth face skull fingers legs arms neck throat house home car family kids head bones nose hands mother father wife husband children daughter son sister brother parents dog knees eyes".split(),
    "SUFFER": "die dies choke rot burn drown suffer bleed perish starve crash mueras mueran pudras atropelle maten mates ahogues parta stirbst verreckst creves".split(),
    "AWAY": "quit leave die stop never go jump disappear vanish resign shut".split(),
    "LOST": "hell lost die away".split(),
    "DWELL": "live park sleep work eat lives parks sleeps works walk wohnst habites vives".split(),
    "PEN": "zoo gutter kitchen jungle sewer cage cages camp camps prison asylum ghetto swamp ovens".split(),
    "LAND": "company country team office city town nation school building village project industry".split(),
    "EXPEL": "throw kick deport drive chase kicked expel drag throwing kicking".split(),
    # sexual
    "SEXUAL": "porn porno xxx nude nudes naked sex sexy erotic explicit horny hardcore hentai adult nsfw".split(),
    "SHOW": "cam cams webcam clip clips video videos pic pics site sites movie movies tube chat show shows photos film films scene scenes".split(),
    "INTIMATE": "tits boobs cock cocks dick dicks pussy pussies nipples clit cunt tit titties penis vagina boner schwanz titten muschi bite chatte polla tetas cono".split(),
    "REAR": "ass butt booty tits boobs arsch cul culo".split(),
    "PRAISE": "nice great big huge hot sexy tight juicy fine hard wet sweet lovely geile geiler belles".split(),
    "CLOTHES": "shirt skirt underwear pants bra dress clothes panties thong boxers blouse trousers bikini lingerie jeans".split(),
    "UNDRESS": "took take takes taking tore ripped pulled slid slipped removed unbuttoned".split(),
    "FUCK": "fuck fvck fck fuk phuck screw fucking".split(),
    "FUCKED": "fuck fucked fucks bang banged shag shagged ficken fickte baiser follar follarte".split(),
    "LEWD": _plural("blowjob handjob cumshot gangbang orgasm threesome creampie deepthroat milf") + "masturbate masturbates masturbated masturbating ejaculate ejaculated cum cumming blasen wichsen".split(),
    "HAVE": "have had having has want wants wanted haben".split(),
    # context
    "SAY": "said says wrote writes called calls calling shouted shouts told posted typed".split(),
    "TERM": _plural("word term phrase string sentence example sample label expression pattern entry") + "worter wort beispiel beispiele mots mot palabras palabra ejemplo".split(),
    "BANNED": "banned flagged forbidden rejected abusive offensive blocked filtered caught prohibited example examples beispiel beispiele exemple exemples ejemplo".split(),
    "INTERJECTION": "oh now just please honestly go and all listen lol so well then ok".split(),
}
for _w in ("der", "die", "das", "el", "la"):
    assert _w in LEXICON["DET"]

PARTS: dict[str, str] = {
    # who
    "TARGET": "YOU / YOUR <1> PARENT",
    "THIRD": "ROLE / HE / whoever <2> this",
    "PEOPLE": "GROUP / GROUP FOLK / DEMONYM / NAME FOLK / KIND FOLK / KIND GROUP / SLUR",
    "THEM": "PEOPLE / all? of? the? PEOPLE / all of? those? PEOPLE",
    # what
    "QUALITY": "DEGRADING / HARSH / LITTLE",
    "ABUSE": "INSULT / QUALITY INSULT / QUALITY QUALITY INSULT / QUALITY QUALITY QUALITY INSULT / piece of shit|garbage|trash|crap / sack of shit / son of a bitch / hijo|hija|hijos de puta / waste of space|air|oxygen|skin / DEGRADING LITTLE? CREATURE / SLUR",
    "BOUND": "STOP / COMMA / END",
    "OPEN": "BEGIN / STOP / COMMA / MARK / INTERJECTION",
    "INTENT": "will|shall / am|are|is? going to / gonna / should|must / would love|like? to? / want to / FUTURE to",
    "DISMISS": (
        "go to hell / burn|rot in hell / shut up / shut your <2> mouth|face|trap / shut the <1> up / get lost / piss|fuck|bugger off / FUCK you|off|yourself|your / screw you / drop dead / eat shit / go die / kiss my ass / get out"
        " / verpiss dich / verpisst euch / halt es? einfach? die|deine|dein? fresse|klappe|schnauze|maul / leck mich / fick dich / hau ab / geh sterben / halt es maul"
        " / vete a la mierda / vete al infierno|diablo / que te jodan|den / jodete / callate / largate / muerete / chinga tu madre / vete"
        " / ferme ta gueule|bouche / ferme la / ta gueule / casse MARK? toi / degage / va te faire voir|foutre|enculer / nique ta / va mourir / creve"
    ),
}

#: (kind, weight, patterns, one on a line); a kind that ends in ~ may be said of oneself
_SCORING: list[tuple[str, float, str]] = [
    # insult + person addressed
    ("insult", 1.0, """
        TARGET BE <4> ABUSE
        BE YOU <2> ABUSE
        bist|eres|sois|etes <3> ABUSE
        YOU MUCH? MUCH? ABUSE
        YOU SURE LIKE <2> ABUSE
        LIKE TARGET DET? ABUSE
        ABUSE COMMA? LIKE <3> TARGET
        ABUSE STOP|COMMA? that BE all YOU BE
        ABUSE that? YOU BE
        DISMISS COMMA? YOU? ABUSE
        DISMISS COMMA? YOU <1> ABUSE
        ABUSE COMMA? DISMISS
        ABUSE COMMA get|keep|take|leave <3> YOUR|YOU
        YOU BE MUCH? MUCH? DEGRADING
        BE YOU MUCH? MUCH? DEGRADING
        YOUR DEGRADING|HARSH <1> hands|face|mouth|opinion|nose|brain|head|paws|fingers|ass|mug
        YOU BE DET? <1> DISGRACE to|of|for
        go|crawl|get back <2> hole|cave|rock|swamp|sewer|basement
        crawl back
        stop|quit wasting <1> air|oxygen|space
        more <1> WITS than TARGET|HE
        smarter than TARGET|HE
        ashamed of YOU BOUND
        ashamed to have <4> YOU|LIKE
        YOUR PARENT <3> ashamed
        PARENT <2> BE? ashamed of? <3> YOU
        NOBODY wants|likes|needs|wanted|loves|quiere|aguanta|aime YOU here|around|anymore|back|in
        NOBODY wants|likes|needs|loves|asked|quiere|soporta YOU BOUND
        NOBODY te|vous quiere|aguanta|soporta|aime
        NOBODY ne? veut|aime <1> de? YOU
        NOBODY will|mag dich
        NOBODY asked|cares for|about? YOUR <2> opinion|view|advice
        do|does us|everyone|everybody|humanity|him|her a favor|favour and MUCH? AWAY
        do the <1> world|team a favor|favour and MUCH? AWAY
        did|must|did YOU? have? sleep|slept YOUR|HE way
        sleep|slept|sleeping YOUR way in|up|to|into
    """),
    ("insult", 0.6, """
        YOU BE MUCH? MUCH? HARSH
        COMMA QUALITY? INSULT BOUND
        you should|must be ashamed
        NAME is DET QUALITY? INSULT
        YOU BE <1> joke
        fire|sack him|her
    """),
    # insult + person spoken of
    ("insult~", 1.0, """
        THIRD <5> BE MUCH? <3> ABUSE
        CREW BE MUCH? MUCH? DEGRADING
        such a|an <2> INSULT
        what a|an <2> INSULT
        what INSULT <1> wrote|did|made
        SUPER QUALITY? <2> INSULT
        written|made|designed|done|reviewed|coded by DET? SUPER? QUALITY? INSULT
        DEGRADING little CREATURE
        HE|they BE DEGRADING|HARSH? COMMA? QUALITY INSULT
        SLUR BE
        DET|YOU|these|those SLUR
        that|this QUALITY? INSULT who|wrote|broke|merged
        only DET QUALITY? INSULT would|could
        too stupid|dumb to live|breathe
    """),
    # hostile imperatives, whose target is the reader
    ("insult", 1.0, """
        go to hell
        burn|rot in hell
        shut up
        shut your <1> mouth|trap
        shut the <1> up
        piss|bugger off
        FUCK you|off|yourself|your
        screw you
        eat shit
        OPEN get lost BOUND
        OPEN get lost YOU|and|already|ABUSE
        OPEN drop dead BOUND
        OPEN drop dead YOU|and|already|ABUSE
        YOU should|can|could all? drop dead
        verpiss dich
        verpisst euch
        halt es? einfach? die|deine|dein? fresse|klappe|schnauze|maul
        leck mich
        fick dich
        geh sterben
        scher dich
        vete a la mierda
        vete al infierno|diablo
        que te jodan|den
        jodete
        muerete
        chinga tu madre
        ferme ta gueule
        ferme la BOUND
        ta gueule
        casse MARK? toi
        va te faire voir|foutre|enculer
        nique ta
        va mourir
        degage de
        degage BOUND
        es|etes MUCH? MUCH? un|une <1> INSULT_TOO
        eres un|una <1> INSULT_TOO
        pauvre|sale|espece|pedazo de? INSULT_TOO
        DISMISS COMMA? INSULT_TOO
        pauvre con|type|fille|idiot|conne
        espece de INSULT
        pedazo de INSULT
    """),
    # threats
    ("threat", 1.0, """
        SPEAKER INTENT MUCH? MUCH? HARM YOU|him
        SPEAKER INTENT <1> HARM YOUR <1> BODY
        SPEAKER INTENT <1> HARM the|this|that PERSON
        SPEAKER INTENT <1> run|hunt|track YOU over|down
        SPEAKER INTENT <1> cut YOU open|up|into
        SPEAKER INTENT <1> make <3> YOU <1> SUFFER|cry|regret|pay|beg
        SPEAKER INTENT <1> find|get YOU and <1> HARM
        SPEAKER INTENT <1> kick YOUR <1> BODY|ass
        HARM YOU open|until
        HARM YOUR BODY in|off|out|down
        HARM YOUR <1> BODY BOUND
        SPEAKER know|knows|found where YOU DWELL
        SPEAKER know|knows|found where YOUR <2> DWELL
        SPEAKER know|knows|found out? where YOU live
        watch YOUR back BOUND
        watch YOUR back ABUSE
        watch YOUR back when|at|on|after
        hope TARGET|HE <4> SUFFER
        hope YOUR BODY <2> SUFFER
        hope YOU and YOUR <4> SUFFER
        hope TARGET|HE <4> get|gets hit|cancer|run|raped|shot|stabbed|sick|beaten
        FOLK|those|devs|INSULT|ROLE LIKE TARGET|HE <1> should|must|deserve|ought <2> HARMED
        FOLK|those|devs|INSULT|ROLE LIKE TARGET|HE <1> should|must|deserve|ought <2> put down|in|into
        FOLK|those|devs|INSULT|ROLE LIKE TARGET|HE <1> should|must|deserve|ought <2> kept|fired in|on|into|out <1> of? a?
        FOLK|those|devs|INSULT|ROLE LIKE TARGET|HE <1> deserve to SUFFER|die
        YOU|HE should|deserve|must to? be HARMED
        NOBODY would|will miss TARGET|him|HE
        world <2> be? better <2> without YOU|him|HE
        better off? without YOU in it
        kill|hang|shoot|drown|neck yourself|yourselves
        jump off|from a|the <1> bridge|cliff|building|roof
        YOU|HE INTENT pay with YOUR|HE
        YOU BE dead BOUND
        YOU BE a dead man
        YOU BE going to die|bleed|burn
        solche|leute|typen|menschen LIKE <1> YOU <1> sollte|sollten|gehoren|musste|muss
        LIKE YOU sollte man
        ich <3> dich|euch <2> um|fertig|kalt|umbringen|abstechen|totschlagen
        ich weiss wo du|ihr wohnst|wohnt
        gens|types|personnes comme YOU COMMA? on devrait
        comme YOU COMMA on devrait
        je vais te|vous tuer|frapper|crever|casser|buter|defoncer|egorger
        je sais ou tu habites|dors|travailles
        tu vas crever|mourir
        ojala te|os|se <1> SUFFER
        te voy a matar|pegar|romper|partir|reventar
        voy a matarte
        se donde vives|trabajas
        gente como tu <1> deberia|merece
    """),
    ("threat", 0.6, """
        YOU will|shall <1> regret|pay
        YOU will <1> SUFFER
        watch out COMMA? ABUSE
    """),
    # hate: a group and what degrades, threatens or excludes it
    ("hate", 1.0, """
        PEOPLE BE DET? MUCH? MUCH? BEAST
        GROUP BE DET? MUCH? MUCH? WASTE
        DEMONYM are|were MUCH? MUCH? WASTE
        FOLK BE DET? MUCH? MUCH? BEAST|WASTE
        PEOPLE BE MUCH? MUCH? DEGRADING|INSULT
        GROUP BE MUCH? all MUCH? HARSH|INSULT|DEGRADING
        PEOPLE COMMA they BE all MUCH? BEAST|WASTE|INSULT
        PEOPLE <4> COMMA they BE all MUCH? BEAST|INSULT
        they BE all MUCH? BEAST
        PEOPLE BE too DEGRADING|HARSH to
        BE BEAST and <1> must|should
        PEOPLE belong|belongs|gehoren in|to|into the|a|ins|in? <1> PEN|trash
        NAME belong in the PEN
        send|ship|deport <2> PEOPLE back
        send <3> PEOPLE home
        PEOPLE <1> should|must go back
        back where|to? where? they|you came from COMMA DEGRADING|BEAST|ABUSE|WASTE
        go back to your <1> country
        deport <1> THEM
        never|not hire|employ|trust|promote|marry <2> PEOPLE
        never|not merge|accept|review|take <2> from PEOPLE
        stop|no hiring|letting <2> PEOPLE
        no PEOPLE allowed
        born DEGRADING|HARSH|BEAST
        EXPEL <5> PEOPLE out|from
        EXPEL all|every|the <3> out of the|our|this LAND
        wipe|exterminate|eradicate|gas|kill|shoot all? THEM
        wipe PEOPLE out
        PEOPLE STOP|COMMA wipe|kill|gas|shoot|deport them
        PEOPLE should|must <1> HARMED
        PEOPLE should|must all? be HARMED|exterminated|eradicated
        PEOPLE should|must not be? allowed|vote|code|program|drive|exist|breed
        PEOPLE should|must all? die|burn|rot|hang|leave
        PEOPLE <1> ruin|steal|infest|invade|breed|rape|poison
        i|we hate|despise|loathe all? <1> PEOPLE
        PEOPLE disgust me|us
        subhuman|subhumans|subhumane scum|trash|filth|race
        too many PEOPLE in|here
        PEOPLE sind <1> BEAST|WASTE
        PEOPLE raus
        auslander raus
    """),
    # sexual
    ("sexual", 1.0, """
        send <1> YOUR|some|more? nudes|nude
        send me nudes
        want|need|like|love|see|imagine|picture YOU|her|him naked|nude
        naked on|in my|his|her bed|lap|desk|chair|office|car|shower|arms
        SEXUAL SEXUAL? SHOW
        live|free|hot SEXUAL SHOW
        explicit|hardcore|oral|anal|rough sex
        horny|naked|nude MUCH? singles|girls|women|men|teens|milfs|housewives|wives|boys|sluts|babes|students|moms
        BE MUCH? horny
        hot horny
        strip|stripping|strips|undress|naked <1> for|on me|you|cam|webcam
        live on cam|webcam
        HAVE <1> sex BOUND
        HAVE <1> sex with|on|in|at|after|before|and|tonight|while|again|all
        PRAISE REAR|INTIMATE
        my|her|his|YOUR PRAISE? PRAISE? INTIMATE
        UNDRESS off? her|his|my|your <1> CLOTHES off?
        he|she|i|they moaned as|when|while|loudly|softly|with|into
        moaned <2> as|while he|she|i|they
        HE moaned BOUND
        come|came over and suck|fuck|ride|lick|undress|strip
        suck my|his|me|this <1> BOUND|INTIMATE
        suck it BOUND
        suck it then|and|dry
        suck|lick|ride|stroke|touch my|his|her|your PRAISE? INTIMATE|REAR
        i|he|she|to INTENT? FUCKED her|him hard|in|on|all|from|again|until
        i|he INTENT <1> FUCKED YOU hard|in|on|all|until|tonight|from
        give|gives|gave|get|got|want|giving|getting|need <2> LEWD
        i|he|she|YOU <1> LEWD
        LEWD SHOW
        schick mir <1> nacktbilder|nacktfotos
        heisse|geile <1> frauen|girls|singles|teens
        will|mochte dich|mit dir? <1> ficken|schlafen
        envoie moi des|tes photos nues|intimes
        je veux te baiser
        suce moi|ma
        mandame fotos desnuda|desnudo
        quiero follarte|cogerte|follar
        chupame la|el?
    """),
]
LEXICON["CREW"] = "author reviewer maintainer boss committer contributor intern colleague coworker ceo director moderator coder programmer teammate whoever he she".split()
LEXICON["DEMONYM"] = []  # told by spelling: see abuse.spelled

#: what takes clauses back: reported speech, terms that are mentioned, oneself
_CONTEXT: list[tuple[str, int, bool, str]] = [
    ("reported", REPORTED, False, """
        calling|called|call someone|somebody|people|others|each|me|him|her
        TERM LIKE|of|is|as|MARK|COMMA|QUOTE
        TERM such as
        score|classify|detect|assert MARK
        moderation <2> lists
        he|she|they|someone|somebody|user|users|bot SAY me? that? MARK|COMMA|QUOTE
        HE SAY that|me
        someone|somebody|user|users SAY that|me
        not|never|nobody|no <2> saying|says|calling|claiming that?
        do not think|believe that?
        must|should flag|catch|match|detect|reject
    """),
    ("reported", REPORTED, True, """
        is|are|counts|count|as <3> BANNED
        gets|get YOU banned|blocked
    """),
    ("self", SELF, False, """
        i|we|me|ich|je|yo|myself BE
        i|we feel|felt|look|looked|like
        i|my|myself
    """),
    ("self", SELF, True, """
        i|ich|je|yo BE|fais
        of me
    """),
]

CLAUSES = [Clause(kind, weight, line.strip()) for kind, weight, block in _SCORING for line in block.strip().split("\n")] + [
    Clause(kind, 0.0, line.strip(), flag, back) for kind, flag, back, block in _CONTEXT for line in block.strip().split("\n")
]
