"""Types, priorities and word lists whose contents decide results."""

from __future__ import annotations


def words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def phrases(text: str) -> frozenset[str]:
    """Comma-separated entries, which may hold blanks."""
    return frozenset(x.strip() for x in text.replace("\n", " ").split(",") if x.strip())


#: Entity types of detectors and the types shown.
TYPES = {
    "PERSON": "PERSONA", "IT_NOME_COGNOME": "PERSONA", "IT_NOME_SUGGERITO": "PERSONA_SUGGERITO",
    "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "TELEFONO", "IT_TELEFONO": "TELEFONO", "CREDIT_CARD": "CARTA",
    "IBAN_CODE": "IBAN", "IT_IBAN": "IBAN", "IT_CODICE_FISCALE": "CF", "IT_FISCAL_CODE": "CF",
    "IT_PARTITA_IVA": "PIVA", "IT_VAT_CODE": "PIVA", "IT_DRIVER_LICENSE": "DOCUMENTO", "IT_PASSPORT": "DOCUMENTO",
    "IT_IDENTITY_CARD": "DOCUMENTO", "IT_CAP": "CAP", "IT_INDIRIZZO": "INDIRIZZO", "IT_DATA_NASCITA": "DATA_NASCITA",
    "IT_LUOGO_NASCITA": "LUOGO_NASCITA", "LOCATION": "LUOGO", "GPE": "LUOGO", "ORGANIZATION": "ORG",
    "IT_ORGANIZZAZIONE": "ORG", "DATE_TIME": "DATA", "MEDICAL_LICENSE": "SANITARIO", "URL": "URL", "IP_ADDRESS": "IP",
    "IT_TARGA": "TARGA", "IT_IMPORTO": "IMPORTO", "IT_CATASTO": "CATASTO", "IT_DOCUMENTO": "DOCUMENTO",
    "IT_NUMERO_SPEDIZIONE": "SPEDIZIONE", "IT_VIN": "VIN", "IT_PRATICA": "PRATICA", "IT_SOCIAL": "SOCIAL",
    "MAC_ADDRESS": "MAC", "CRYPTO": "CRYPTO",
}
#: Who wins where spans overlap; others have 5.
PRIORITIES = {
    "CF": 10, "DATA_NASCITA": 10, "LUOGO_NASCITA": 10, "PIVA": 9, "IBAN": 9, "DATA": 9, "CARTA": 8, "EMAIL": 8,
    "INDIRIZZO": 8, "IT_ORGANIZZAZIONE": 8, "URL": 8, "IP": 8, "TARGA": 8, "CATASTO": 8, "VIN": 8, "PRATICA": 8,
    "SOCIAL": 8, "MAC": 8, "TELEFONO": 7, "LUOGO": 7, "PERSONA": 6, "DOCUMENTO": 6, "SPEDIZIONE": 6, "IMPORTO": 5,
    "ORG": 4, "CAP": 2,
}
#: Types for which a full score isn't absolute priority.
NEVER_ABSOLUTE = words("DATA DATA_NASCITA LUOGO LUOGO_NASCITA INDIRIZZO")
#: Categories that are on unless said otherwise, and sets for common uses.
DEFAULT_CATEGORIES = words("PERSONA EMAIL TELEFONO IBAN CF PIVA CARTA CAP INDIRIZZO SANITARIO DOCUMENTO DATA_NASCITA LUOGO_NASCITA TARGA VIN PRATICA SOCIAL")
PRESETS = {
    "tecnico": DEFAULT_CATEGORIES,
    "personale": DEFAULT_CATEGORIES | {"LUOGO", "DATA"},
    "contratto": DEFAULT_CATEGORIES | {"ORG", "IMPORTO", "DATA"},
}
ALL_CATEGORIES = frozenset(TYPES.values())
#: Types of persons, of suggestions, and those never masked; scores; characters of a block.
PERSON_TYPES = words("PERSON PERSONA IT_NOME_COGNOME")
SUGGESTED_ONLY = {"IT_NOME_SUGGERITO": "PERSONA", "IT_CARTA_SOSPETTA": "CARTA"}
NEVER_MASKED = words("MISC NORP MONEY PERCENT QUANTITY ORDINAL CARDINAL EVENT WORK_OF_ART LAW LANGUAGE FAC PRODUCT TIME JOB_TITLE")
#: Types that arithmetic or format has confirmed: the noise filter passes them.
NOISE_EXEMPT = words("IT_CODICE_FISCALE IT_FISCAL_CODE IT_PARTITA_IVA IT_VAT_CODE IT_IBAN IBAN_CODE CREDIT_CARD EMAIL_ADDRESS IT_TARGA IT_VIN IT_CATASTO IT_PRATICA IT_SOCIAL IT_DOCUMENTO MAC_ADDRESS CRYPTO IT_ORGANIZZAZIONE")
ACCEPT, CERTAIN = 0.4, 0.7
BLOCK_CHARS = 25_000

#: Months and their numbers.
MONTHS = {
    "gennaio": 1, "febbraio": 2, "marzo": 3, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "agosto": 8,
    "settembre": 9, "ottobre": 10, "novembre": 11, "dicembre": 12, "gen": 1, "feb": 2, "mar": 3, "apr": 4, "mag": 5,
    "giu": 6, "lug": 7, "ago": 8, "set": 9, "sett": 9, "ott": 10, "nov": 11, "dic": 12,
}
#: Length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Weights of the characters at odd places of a tax code, 0-9 then A-Z; at even places a character counts its own number.
CF_ODD = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)

#: Words that make a text Italian, or English.
ITALIAN_HINTS = """
il lo la gli le un una uno di da del della dello degli delle dei dal dalla in su sul sulla con per tra fra e ed o od
che non ma se come è sono siamo siete sei era erano essere ha hanno abbiamo avete hai aveva avere sta stanno stiamo
stai stava stare fa fanno fatto fare informiamo confermiamo comunichiamo preghiamo invitiamo prega invita conferma
informa riscontro allega signor signora signorina sig sig.ra dott dott.ssa nome cognome telefono cellulare email posta
indirizzo via corso piazza viale largo vicolo cliente fornitore societa società studio azienda ufficio fattura
contratto preventivo documento colloquio cortese gentile distinti cordiali saluti
""".split()
ITALIAN_ACCENTS = "àèéìíòóùúÀÈÉÌÍÒÓÙÚ"
ENGLISH_HINTS = "the and of to is are was were for with from by this that have has had will would shall should please dear regards".split()

#: Word lists about persons, roles, places, brands and files, each used whole.
HONORIFICS = words("""
dottor dottore dottoressa dott dott.ssa dott.sa dr sig sig.ra sig.na signor signora signorina ing arch avv avvocato
geom prof professor professore professoressa rag egr egregio gentile""")
#: Words that don't tell persons apart.
NOT_TELLING = words("""
sig sig.ra sig.na signor signora signorina dott dott.ssa dott.sa dottor dottore dottoressa dr ing ingegner ingegnere
arch architetto avv avvocato avvocata geom geometra prof professor professore professoressa rag ragionier ragioniera
egr egregio egregia gentile gentilissimo gentilissima caro cara carissimo carissima il la lo i gli le un uno una
cliente fornitore collega paziente""")
NAME_CONNECTORS = words("De Del Della Delle Dello Degli Dei Di Da Dal Dalla Dalle Dallo Dagli La Lo Le Li Su Van Von Der D' D")
SURNAME_PARTICLES = words("de di da del dello della delle degli dei dal dalla dallo dalle dagli dai lo la le li van von der")
MERGE_PARTICLES = SURNAME_PARTICLES | words("d' l' dell' nell'")
#: Words of roles and offices, and what may stand beside them.
ROLES = words("""
amministratore amministratrice direttore direttrice direzione presidente vicepresidente vice-presidente consigliere
consigliera responsabile coordinatore coordinatrice segretario segretaria tesoriere tesoriera revisore revisora capo
vicecapo socio socia collaboratore collaboratrice delegato delegata referente manager""")
ROLE_QUALIFIERS = words("""
delegato delegata generale generali finanziario finanziaria commerciale commerciali tecnico tecnica tecnici operativo
operativa unico unica unici aggiunto aggiunta esecutivo esecutiva supplente supplenti ordinario ordinaria straordinario
straordinaria amministrazione gestione vigilanza risorse umane personale vendite acquisti marketing produzione qualità
qualita sistemi informativi informatici""")
ROLE_CONNECTORS = words("di del della delle dello e ed al alla")
OFFICES = words("""
ufficio uffici servizio servizi consiglio comitato assemblea collegio direzione presidenza amministrazione segreteria
commissione gruppo reparto sezione divisione unita unità team""")
#: Words at the edges of names, formulas, and words that are no surnames.
REGISTRY_WORDS = words("""
nato nata nate nati nasce nascere residente residenti domiciliato domiciliata originario originaria coniugato coniugata
sposato sposata detto detta chiamato chiamata presso ha hanno è era erano sono sei sarà sarebbe""")
FUNCTION_WORDS = words("""
a ad in il lo la le gli l' un una uno un' di da del della delle dei degli dal dalla con per su fra tra senza verso che
e o ma come""")
EXCLUDED_FORMULAS = words("""
gentile gentilissima gentilissimo caro cara carissimo carissima buongiorno buonasera buonanotte salve cordiali distinti
cordialmente grazie prego ciao arrivederci egregio egregia spettabile signor signora signorina dottore dottoressa
dottor professore professoressa avvocato avvocata ingegnere architetto geometra santo santa beato beata ing dott arch
avv geom prof rag sig dr dr.ssa sig.ra sig.na fra don padre madre suora papa fratelli sorelle figlio figlia moglie
marito presidente amministratore direttore responsabile condominio azienda societa impresa studio ufficio""")
NOT_SURNAMES = words("""
il lo la i gli le un uno una di a da in con su per tra fra del della dello delle degli dei al alla allo alle agli ai
dal dalla dallo dalle dagli dai sul sulla sullo sulle sugli sui e ed o od ma però quindi poi che chi cui come quando
dove perché è sono ho hai ha abbiamo avete hanno sei siete siamo era eravamo erano sta stanno stiamo va vado vai
andiamo posso puoi può possiamo potete possono voglio vuoi vuole vogliamo volete vogliono non solo anche ancora già
sempre mai molto poco abbastanza quasi tanto domani ieri oggi adesso ora qui qua là lì arriva arriverà arrivo arrivi
viene vengo vieni verrà chiama chiamo chiami dice dico dici dirà scrive scrivo scrivi lavora lavoro lavori manda mando
mandi parla parlo parli fa faccio fai vede vedo vedi vedrà risponde rispondo rispondi nato nata nati nate abita abito
abiti italiano italiana italiani italiane""")
NEVER_LOWER_NAMES = words("domenica natale alba sole luce salvo massimo santo sante fede amore")
SENTENCE_OPENERS = words("""
Il Lo La I Gli Le Un Uno Una Questo Questa Quello Quella Mio Mia Tuo Tua Suo Sua Nostro Vostro Signor Signora Signorina
Sig Dott Dr Prof Egr Spett Gentile Caro Cara Grazie Ciao Salve Buongiorno Buonasera Buonanotte Cordiali Distinti Saluti
Cari Care Oggi Ieri Domani Roma Milano Napoli Torino Firenze Venezia Bologna Genova Palermo Bari Verona Catania Via
Viale Piazza Piazzale Corso Largo Vicolo Strada Vico Contrada Frazione Località Borgo Lungomare Salita Traversa""")
#: Words in and after places, and cities abroad.
PLACE_STOPS = words("""
il l' lo la i gli le in a ad da di del dello della delle degli dei dal dalla dallo dalle dagli dai con per tra fra su
sul sulla sullo e ed o od ma però che chi cui come quando dove perché è sono ho ha hai abbiamo avete hanno sei siete
siamo era sarà un una uno nato nata nasce residente domiciliato originario presso""")
PLACE_CONNECTORS = words("""
di del della delle dello degli dei a al alla allo alle agli ai in nel nella nello nelle nei negli d' dell' dall' nell'
sull' all' sant' san santa santo santi sante ss. sotto sopra presso monte monti colle valle val ponte bagno campo""")
FOREIGN_CITIES = phrases("""
londra, london, parigi, paris, berlino, berlin, madrid, barcellona, barcelona, lisbona, lisboa, amsterdam, bruxelles,
brussels, vienna, wien, praga, prague, budapest, varsavia, warsaw, atene, athens, istanbul, mosca, moscow,
san pietroburgo, new york, los angeles, san francisco, chicago, boston, washington, toronto, montreal, vancouver,
città del messico, buenos aires, san paolo, rio de janeiro, il cairo, cape town, johannesburg, casablanca, dubai,
abu dhabi, riyadh, tel aviv, gerusalemme, pechino, beijing, shanghai, tokyo, seoul, singapore, bangkok, hong kong,
mumbai, delhi, kolkata, sidney, sydney, melbourne, auckland, malta, la valletta, san marino""")
#: Technical terms and brands, file extensions, and countries.
TECHNICAL = phrases("""
var, cvar, nav, beta, alpha, sharpe, sortino, drawdown, volatility, volatilità, correlation, monte carlo, montecarlo,
msci, s&p500, s&p 500, sp500, ftse, nasdaq, dow jones, vix, bootstrap, backtest, rebalancing, market cap, eps, p/e,
roe, roi, roic, sqlite, wal, json, yaml, toml, xml, csv, api, rest, graphql, grpc, http, https, sql, python,
javascript, typescript, rust, golang, telegram, slack, discord, signal, whatsapp, launchd, systemd, cron, crontab,
macos, windows, linux, unix, ios, android, docker, kubernetes, k8s, aws, gcp, azure, postgresql, mysql, mongodb,
redis, fastapi, django, flask, react, vue, angular, numpy, pandas, pytorch, tensorflow, sklearn, presidio, spacy,
transformers, gliner, pyinstaller, webview, pywebview, yahoo, yahoo finance, stripe, paypal, tradegate,
trade republic, traderepublic, finnhub, polygon, coingecko, coinmarketcap, ecb, bce, fed, google, microsoft, apple,
amazon, meta, facebook, instagram, twitter, x, linkedin, github, gitlab, openai, anthropic, gemini, deepmind, netflix,
spotify, tesla, nvidia, intel, amd, ibm, oracle, adobe, salesforce, huggingface, hugging face, istat, eurostat,
world bank""")
FILE_EXTENSIONS = """
py js ts tsx jsx json yaml yml toml xml csv tsv md markdown rst txt log html htm css scss sass less sh bash zsh fish
ps1 bat cmd sql db sqlite sqlite3 png jpg jpeg gif svg webp ico bmp pdf docx xlsx pptx odt ods odp rtf eml msg mbox
zip tar gz bz2 xz 7z rar wav mp3 flac ogg aac mp4 mov avi mkv exe dll so dylib app dmg pkg deb rpm env cfg conf ini
safetensors pt pth onnx gguf bin ipynb rb go rs java kt swift cs cpp cc c h hpp hxx
""".split()
COUNTRIES = phrases("""
africa, america, asia, europa, oceania, antartide, eurasia, scandinavia, balcani, caucaso, maghreb, medio oriente,
estremo oriente, sudamerica, nordamerica, centroamerica, sudafrica, italia, francia, germania, spagna, portogallo,
grecia, austria, svizzera, belgio, olanda, paesi bassi, lussemburgo, danimarca, norvegia, svezia, finlandia, islanda,
irlanda, regno unito, inghilterra, scozia, galles, polonia, ungheria, romania, bulgaria, cechia, repubblica ceca,
slovacchia, slovenia, croazia, bosnia, serbia, montenegro, macedonia, kosovo, albania, estonia, lettonia, lituania,
bielorussia, ucraina, moldavia, russia, turchia, cipro, malta, monaco, andorra, liechtenstein, vaticano, cina, india,
giappone, corea, corea del sud, corea del nord, vietnam, thailandia, cambogia, laos, birmania, myanmar, indonesia,
filippine, malesia, singapore, pakistan, bangladesh, nepal, bhutan, sri lanka, afghanistan, iran, iraq, siria, libano,
israele, palestina, giordania, arabia saudita, yemen, oman, qatar, bahrein, kuwait, emirati arabi, kazakistan,
uzbekistan, turkmenistan, kirghizistan, tagikistan, azerbaigian, armenia, georgia, mongolia, taiwan, egitto, libia,
tunisia, algeria, marocco, sudan, etiopia, eritrea, somalia, gibuti, kenya, uganda, tanzania, ruanda, burundi, congo,
camerun, nigeria, ghana, costa d'avorio, senegal, mali, niger, ciad, burkina faso, guinea, sierra leone, liberia,
gambia, mauritania, angola, zambia, zimbabwe, mozambico, namibia, botswana, madagascar, mauritius, seychelles,
stati uniti, canada, messico, guatemala, honduras, salvador, nicaragua, costa rica, panama, cuba, giamaica, haiti,
repubblica dominicana, bahamas, brasile, argentina, cile, uruguay, paraguay, bolivia, peru, perù, ecuador, colombia,
venezuela, guyana, suriname, australia, nuova zelanda, figi, papua nuova guinea""")
#: Names that truecasing leaves alone.
NOT_CAPITALISED = words("""
ing dott arch avv geom prof rag sig dr gentile buongiorno buonasera salve ciao arrivederci grazie prego cordiali
distinti signor signora signorina papa san santo santa amministratore direttore presidente""")
#: Verbs that aren't surnames though they may follow a particle, and so aren't capitalised.
VERBS_AFTER_PARTICLE = words("""
posso puoi può possiamo potete possono voglio vuoi vuole vogliamo volete vogliono so sai sa sappiamo sapete sanno vedo
vedi vede vediamo vedete vedono faccio fai fa facciamo fate fanno dico dici dice diciamo dite dicono penso pensi pensa
pensiamo pensate pensano credo credi crede crediamo credete credono aspetto aspetti aspetta aspettano conosco conosci
conosce conosciamo conoscete conoscono chiamo chiami chiama chiamiamo chiamate chiamano arrivo arrivi arriva arriviamo
arrivate arrivano vado vai va andiamo andate vanno porto porti porta portiamo portate portano""")
#: Units that look like the letters of a plate.
MEASURE_UNITS = words("KB MB GB TB KM KG MM CM MT HZ KW CV HP MQ ML DB PT PX")
#: Labels of a pluggable model and the types they become; other labels are dropped.
MODEL_LABELS = {
    "FULLNAME": "PERSON", "ORG": "ORGANIZATION", "STREET": "LOCATION", "CITY": "LOCATION", "PROVINCE": "LOCATION",
    "BUILDINGNUM": "LOCATION", "ZIPCODE": "IT_CAP", "DATE": "DATE_TIME", "TIME": "DATE_TIME", "EMAIL": "EMAIL_ADDRESS",
    "TELEPHONENUM": "PHONE_NUMBER", "IBAN": "IT_IBAN", "CREDITCARDNUMBER": "CREDIT_CARD", "CF": "IT_CODICE_FISCALE",
    "PIVA": "IT_PARTITA_IVA", "CATASTO": "IT_CATASTO", "TARGA": "IT_TARGA", "AMOUNT": "IT_IMPORTO",
    "DOCID": "IT_DOCUMENTO", "ID_DOC": "IT_DOCUMENTO",
}


def shown(entity_type: str) -> str:
    """The type of an entity type; unknown ones stay, in capitals."""
    return TYPES.get(entity_type, entity_type.upper())


def priority(entity_type: str) -> int:
    return PRIORITIES.get(entity_type, PRIORITIES.get(shown(entity_type), 5))
