"""Annotated sentences to which the segment model is fitted: {kind|text} marks a span. All content is invented.

Names, places and other values are made of random syllables, so that no list of names is learned: what the model learns is
the shape of spans and the words around them.
"""

from __future__ import annotations

import random
import re
from functools import cache

_MARK = re.compile(r"\{(email|phone|id_number|address|name)\|(.+?)\}(?!\})")

#: Sentences; NAME, MAIL, PHONE, IDNO, ADDR_xx, WORD (a capitalised invented word), TAXON and 9-runs are filled in, a|b|c
#: in angle brackets stands for one of them.
TEMPLATES = """
Questions? Ask MAIL for details.
Complaints should be sent to MAIL today.
<!-- owner: MAIL -->
(MAIL)
<MAIL>
| mail = MAIL
e-mail: MAIL
[mailto:MAIL contact us] Our shop is open.
Pour toute question, contactez MAIL avant lundi.
Envoyez vos photos à MAIL svp.
Fragen bitte an MAIL richten.
Rückmeldung an MAIL erbeten.
Consultas a MAIL antes del lunes.
Escríbanos a MAIL y le contestamos.
prices start @ 25 euros in the shop
meet @ 9 o'clock near the gate
Anyone may mail MAIL with ideas. The shop closed.
phone PHONE <and|or> leave a message
reach us on PHONE. Thanks.
Phone: PHONE
Phone PHONE
Tel PHONE
Tel: PHONE
Tel.: PHONE
Tel:PHONE
tel:PHONE
Fax: PHONE
Mobile: PHONE (evenings)
Tél. : PHONE
Tél. : PHONE Ouvert le lundi.
Tel: PHONE Open on Monday.
Phone: PHONE In winter we close.
call PHONE Every winter we close.
Tél. : PHONE À Noël, la boutique ferme.
Tél. : PHONE D'habitude, la boutique ferme.
Passeport n° IDNO D'habitude, la boutique ferme.
Carte d'identité n° IDNO
ID card no. IDNO Every winter we close.
Pasaporte n.º IDNO En invierno cerramos.
Passeport n° IDNO Tél. : PHONE
| phone = PHONE
| Telefon = PHONE
| tél = PHONE
| teléfono = PHONE
| fax = PHONE
<!-- PHONE -->
The desk is staffed on PHONE until noon.
Le bureau est joignable au PHONE en semaine.
La oficina contesta en el PHONE los lunes.
Auskunft gibt es unter PHONE werktags.
téléphonez au PHONE
ruft PHONE an, bitte
marque el PHONE hoy
<call|ring|dial> PHONE <today|soon|now>
| remarks = PHONE
| note = PHONE
SSN IDNO appears on page 9.
Social security number: IDNO
ID card no. IDNO, valid until May.
Her passport number is IDNO.
passport IDNO
| national_id = IDNO
| documento = IDNO
| Ausweis = IDNO
| pièce = IDNO
| tax_id = IDNO
the form gives IDNO as the applicant's tax number
El DNI de la clienta es IDNO.
DNI IDNO
Pasaporte n.º IDNO
Passeport n° IDNO Le bureau ferma.
Numéro de sécurité sociale : IDNO
Son numéro de sécurité sociale est le IDNO.
Le dossier indique le numéro fiscal IDNO.
Die Steuer-ID IDNO steht oben.
Sozialversicherungsnummer: IDNO
Versicherungsnummer IDNO
Ihre Ausweisnummer ist IDNO.
Personalausweis Nr. IDNO
Reisepass IDNO
Numéro fiscal IDNO du client.
El contrato muestra el número fiscal IDNO del cliente.
Número de la seguridad social: IDNO
Tax number IDNO
NIF: IDNO
NIE IDNO
compare edit 99999999 and edit 99999999
see revision 9999999 of the page
diff 99999999 was undone
Population 9 999 999 (1999-1999).
Population 99 999 999 (1999-2009).
Inhabitants: 9,999,999 in 1999
Catalogue number 999-99-B, box 99.
Catalogue number 9999-99-C, box 9.
The collection number is 999-99-A, drawer 9.
ISBN 978-9-99-999999-9
ISBN 9-999-99999-9
doi:10.9999/9999.99999
doi:10.9999/999.9999
accession QC_999999.9, 999 bp
accession NM_9999999.9, 999 bp
gene bank AB999999, 999 bp
pp. 999-999, vol. 99, no. 9
https://site.example:8080/page/9999999
https://site.example/item-9999999.html
{{coord|99.9999|99.9999|type:town}}
[[User:192.0.2.99]] 09:59
[[User:203.0.113.999]] 19:09
[[User:198.51.100.99]] 29:09
host 10.99.99.99 answered
9.9.1999 09:59
29.9.1999 19:59
Der Laden war leer. 29.9.1999 19:59
9.19.1999 29:59
19.11.1999 19:59
1999-09-19 09:59:59
2009-11-19T19:59
card 9999 9999 9999 9999 was charged
paid with 9999-9999-9999-9999 in May
account 9999 9999 9999 9999 99 at the bank
| Place || 99999 || 1999 || bakery
'''NAME''' (1899-1999). The shop stood there.
(1899-1999)
Values of 3.14159 and 1,234,567.89 were measured.
Bus 99 passes the square.
The census of 1999 counted 9999 people.
order 99999999 left in 1999
item 9999-9999 in the list
part no. 999-9999-99
serial 99999999999
| pop = {{formatnum:99999}}
{{mail}} {{user address}}
{{year|1999}} and {{year|9999}}
Parcels reach her at ADDR_EN, Lowtown.
send it to: ADDR_EN
Address: ADDR_EN
| home = ADDR_EN
| address = ADDR_EN
The family lives at ADDR_EN.
The office moved from ADDR_EN last year.
She moved to ADDR_EN.
He still works at ADDR_EN. The shop is <open|closed>.
He still works at ADDR_EN. In winter it is <open|closed>.
He still works at ADDR_EN. nobody in the office <came|knew>
send it to: ADDR_EN The office was quiet.
send it to: ADDR_EN In winter it is closed.
Pakete an: ADDR_DE
| Wohnsitz = ADDR_DE
| Anschrift = ADDR_DE
Die Familie lebt ADDR_DE, Neustadt.
Das Büro zog 1999 aus ADDR_DE weg.
Pakete an: ADDR_DE Das Büro ist zu.
| domicile = ADDR_FR
| adresse = ADDR_FR
Colis : ADDR_FR
Colis : ADDR_FR La boutique ferma.
Colis : ADDR_FR Le bureau ferma.
Colis : ADDR_FR Depuis 1999, le bureau est fermé.
Colis : ADDR_FR Chaque hiver, le bureau ferme.
Colis : ADDR_FR En 1999, le bureau ferma.
Colis : ADDR_FR Passeport n° IDNO
Colis : ADDR_FR Tél. : PHONE
Colis : ADDR_FR Signé par NAME.
Colis : ADDR_FR Mme NAME ouvrit la boutique.
Colis : ADDR_FR Remarques à adresser à MAIL.
Colis : ADDR_FR NAME fonda la boutique en 1999.
Colis : ADDR_FR Selon NAME, le bureau ferma.
Sa famille habite ADDR_FR, à Neuville.
Le bureau quitta le ADDR_FR en 1999.
| domicilio = ADDR_ES
| dirección = ADDR_ES
Paquetes a: ADDR_ES
La familia vive en ADDR_ES, Villanueva.
La oficina se mudó de ADDR_ES en 1999.
la spedizione va a ADDR_IT
| indirizzo = ADDR_IT
the <Tanner Lane|Old Quay|Harbour Street|Market Road> stop opened in 1999
the rue des Lilas stop opened in 1999
die Haltestelle Lindenweg wurde 1999 eröffnet
la parada Calle del Olmo abrió en 1999
In 1999 North Mill Road was closed.
| <author|writer|editor|photographer|director|spouse|owner|contact|witness|translator> = NAME
| <auteur|autrice|photographe|propriétaire|conjoint|traducteur> = NAME
| <Autor|Autorin|Fotograf|Inhaber|Ehefrau|Übersetzer> = NAME
| <autor|autora|fotógrafo|propietario|cónyuge|traductor> = NAME
<author|photo|editor|translation|interview|signed>: NAME
According to NAME, <nobody|no one|the clerk|the town> <came|knew|agreed>.
According to NAME, the bakery was closed.
Selon <NAME|NAME>, la boutique était fermée.
D'après NAME, personne ne vint.
Según NAME, la tienda estaba cerrada.
Laut NAME war der Laden geschlossen.
Nach Angaben von NAME war niemand da.
<Written|Reported|Painted|Signed|Drawn|Filmed|Edited|Translated|Sold|Found> by NAME in May.
a <book|song|letter|painting|photo|review> by NAME appeared
The bakery was <praised|described|visited|bought|seen|built|measured> by NAME.
<Écrit|Rapporté|Signé|Peint|Signalé|Vendu|Traduit> par NAME.
<Escrito|Firmado|Pintado|Avisado|Vendido|Traducido> por NAME.
<Gemeldet|Geschrieben|Gemalt|Entdeckt|Fotografiert|Verkauft> von NAME.
<Dr.|Prof.|Mr.|Mrs.|Ms.|Sir|Captain|Judge|Mayor|Sister|Father> NAME <led|ran|joined|left|opened|directed> the <class|course|tour|project|hospital> of 1999.
<Frau|Herr|Dr.|Professor|Bürgermeister|Schwester> NAME <leitete|besuchte|gründete|eröffnete> die Schule.
<Frau|Herr> NAME kam an.
<Mme|M.|Mlle|Docteur|Maître|Monsieur|Madame> NAME <dirigea|ouvrit|visita|quitta> l'école.
<La Sra.|El Sr.|Don|Doña|El Dr.|La Dra.> NAME <dirigió|abrió|visitó|dejó> la escuela.
[[NAME]] <bought|sold|left|visited|rebuilt|inherited|founded|designed> it in 1999.
[[NAME]] <acheta|vendit|visita> la ferme en 1999.
[[NAME]] <kaufte|verkaufte|besuchte> den Hof im Jahr 1999.
[[NAME]] <compró|vendió|visitó> la finca en 1999.
NAME <designed|built|founded|painted|wrote|directed|bought|sold|visited|discovered|joined|led|planned|drew|composed|married|taught|won|said|recorded> the <house|bakery|school|song|court|club|garden|race> in 1999.
NAME <was|is> a <poet|painter|teacher|farmer|lawyer|doctor|nurse|sailor|priest|singer> from the north.
NAME <est|était> <un poète|une poète|médecin|avocate|marin>.
NAME <war|ist> <Dichter|Ärztin|Bäcker|Lehrerin>.
NAME <fue|es> <poeta|médica|panadero|maestra>.
NAME <dessina|construisit|fonda|peignit|écrivit|dirigea|acheta|vendit|visita|découvrit> la maison en 1999.
NAME <diseñó|construyó|fundó|pintó|escribió|dirigió|compró|vendió|visitó|descubrió> la casa en 1999.
NAME <entwarf|baute|gründete|malte|schrieb|leitete|kaufte|verkaufte|besuchte|entdeckte> das Haus um 1999.
<Everybody|Nobody|My sister|The whole class|Her boss> <knows|met|thanked|asked|called|told|saw|likes|hates|believes> NAME.
<Everybody|Nobody|My sister|The whole class> <knows|says|thinks|believes> NAME is <late|lazy|a fool|a fraud|sick>
<Everybody|Nobody|My sister|The whole class> <knows|says|thinks|believes> NAME is <late|lazy|a fool|a fraud|sick> Then the shop closed.
Talks with NAME and NAME ended.
Thanks to NAME for the photo.
NAME, a <teacher|baker|nurse>, came first.
NAME and NAME married in 1999.
NAME (born 1999) lives here.
'''NAME''' <was|is> a <poet|painter|sailor>.
'''NAME''' (9 May 1899 - 1 June 1999) was a sailor.
* NAME, clerk
Her son, NAME, <left|stayed>.
send it to: ADDR_EN NAME founded the bakery in 1999.
Pakete an: ADDR_DE NAME gründete den Laden um 1999.
phone PHONE and leave a message NAME founded the bakery.
The bakery was <full|empty|new>. NAME <designed|built|founded|painted|visited|bought|sold> the <house|school|garden> in 1999.
The bakery was <full|empty|new>. [[NAME]] <designed|built|sold|painted|visited|bought|left> it in 1999.
<La boutique était vide|Le village compte 999 habitants|Le reçu est au client>. NAME <dessina|construisit|fonda|peignit|visita|acheta> la maison en 1999.
<El recibo es del cliente|La calle es tranquila|Vive aquí con 999 vecinos|La casa era vieja>. NAME <diseñó|construyó|fundó|pintó|visitó|compró> la casa en 1999.
We met NAME <at noon|on Monday|in the park|again|there>.
I <saw|visited|asked|thanked|called> NAME <at noon|on Monday|in the park|again|there>.
La tienda tenía 999 clientes. NAME <diseñó|construyó|fundó|pintó|visitó|compró> la casa en 1999.
Der Laden war leer. NAME <entwarf|baute|gründete|malte|besuchte|kaufte> das Haus um 1999.
According to NAME, the bakery was closed. Selon NAME, la boutique était fermée.
<Port|Upper|Lower|Mount|Lake|North|South|East|West|New|Old|Great|Little|Saint|San|Santa|Cape|Fort|Bad|Alt|Neu|Sankt|Camp|Glen|Isle|Villa> WORD <lies|is|grew|stands> on the coast.
<Port|Upper|Lower|Mount|Lake|North|South|East|West|New|Old|Great|Little|Saint|San|Santa|Cape|Fort> WORD lies on the coast. The shop closed.
[[<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint|San|Cape|Fort> WORD]] is <deep|small|old>.
| <Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint|San|Cape|Fort> WORD || 9999 || 1999 || bakery
| [[<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD]] || 9999 || 1999 || bakery
'''<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD''' is a town.
| name = <Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD
list=[[<Port|Upper|Lower|Mount|Lake|North|New|Old> WORD]] · [[WORD]]
the <baker|market|road|clerk> of <Port|Upper|Lower|Mount|Lake|North|New|Old|Great> WORD <sold|visited|painted|led> the farm
<near|from|to|in|at|towards> <Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD, the road <ends|forks>
<near|from|to|in|at|towards|of> WORD WORD, the road <ends|forks>
le marché <de|à|vers|près de> <Port|Saint|Mont|Lac|Grand|Vieux> WORD ferma.
el mercado <de|en|hacia> <Puerto|San|Santa|Monte|Lago|Río|Nuevo> WORD cerró.
der Markt <von|in|bei|nach> <Bad|Sankt|Port|Groß|Klein|Alt> WORD schloss.
The WORD <Bridge|River|Abbey|Hall|Museum|Festival|Company|Railway|Theatre|Valley|Island|Hotel|Society|School|Street|Church> <closed|opened|crosses|reopened> in 1999.
WORD <Bridge|River|Abbey|Hall|Museum|Festival|Company|Railway|Theatre|Valley|Island|Hotel|Society|School|Street|Church|Creek|County|Council> <closed|opened|grew|reopened> in 1999.
<North|Old|Royal|National|Central> WORD <Bridge|Hall|Museum|Company|Railway|Valley> <closed|opened> in 1999.
Mount WORD Peak rises there.
Upper WORD Hill was sold.
The ship ''WORD WORD'' sank in 1999.
The ship ''WORD'' sank in 1999.
The <film|novel|album|newspaper|yacht> ''WORD WORD'' appeared in 1999.
Saint WORD Abbey was closed.
University of WORD
the <baker|market|road|clerk> of [[<Port|Upper|Lower|Mount|Lake|North|New> WORD|<Port|Upper|Lower|Mount|Lake|North|New> WORD]] <sold|visited|recorded> the farm
[[<Port|Upper|Lower|Mount|Lake|North|New> WORD|WORD WORD]]
| <remarks|note|caption> = NAME <designed|built|founded|painted|visited|bought> the house in 1999.
| <remarks|note|légende> = NAME <dessina|construisit|fonda|peignit|visita|acheta> la maison en 1999.
| <remarks|note|leyenda> = NAME <diseñó|construyó|fundó|pintó|visitó|compró> la casa en 1999.
| <remarks|note|Anmerkung> = NAME <entwarf|baute|gründete|malte|besuchte> das Haus um 1999.
<von|de|of|bei|près de|near|from|to> [[<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD]].
la ferme de <Port|Saint|Mont|Grand|Vieux|Upper> WORD <vendit|acheta|visita|ferma|peignit> le pont.
la finca de <Puerto|San|Monte|Nuevo|Port|Upper> WORD <vendió|compró|visitó|cerró|pintó> el puente.
<doch|und|aber|denn|weil> <die|der|das> WORD von WORD <stand|kaufte|half|schwieg|brannte|wuchs|lag|gewann|verlor|zog>
<die|der|das|den> WORD von WORD
<am|im|vom|zum|beim|ein|des|zur> WORD von WORD <stand|,|und|bis WORD|bei WORD>.
<am|im|vom|zum|beim|ein|des|zur> WORD von WORD. <Der|Die|Das> WORD stand leer.
<der|die|das|den> WORD von <Port|Upper|Bad|Neu|Alt|Groß> WORD <stand|kaufte|half|beschrieb|schloss> das Haus.
<der|die|das|den> WORD von WORD von WORD <stand|bis|nach|kaufte|half> WORD.
von <Port|Upper|Bad|Neu|Alt|Groß> WORD <bis|nach|und|kaufte|half|schloss> WORD
<die|der|das|den|dem|eine|einen> WORD von WORD <stand|verfiel|half|kaufte|beschrieb|schloss>
<Die|Der|Das> WORD von WORD <stand|verfiel|half|kaufte|beschrieb|schloss> 1999.
mit 99 WORD von WORD
im Jahr 1999. <Die|Der|Das> WORD von [[WORD]] stand leer.
le WORD de WORD ferma. la WORD de WORD ouvrit.
El WORD de WORD cerró.
[[User:WORD_99]] 19:09
[[User talk:WORD WORD]]
user WORD WORD reverted
[[Category:WORD WORD]]
[[File:WORD WORD.jpg|thumb]]
== WORD WORD ==
{{WORD WORD|1999}}
According to WORD, nothing changed.
According to the WORD WORD Report, nothing changed.
TAXON was found there.
''TAXON'' grows near WORD.
CHEAP WORD SHOES NOW
CHEAP SHOES NOW!!! CHEAP SHOES ee?gg a f
CHEAP UWORD NOW!!! CHEAP UWORD gd?a e! fc
vor doch WORD von WORD neben über WORD WORD heimlich Die WORD
A QUIET MORNING CAME. NOBODY KNEW THE WAY TO THE OLD GATE OF UWORD. WHAT CAME NEXT?
THE UWORD KEEPER SOLD AN EMPTY BARN NEAR THE ROAD. A LONG NIGHT PASSED
EL DUEÑO VENDIÓ LA CASA VIEJA AL LADO DE UWORD. ¿QUÉ PASÓ LUEGO?
LE MAIRE VENDIT LA FERME VIDE PRÈS DE UWORD. QUE FAIRE ENSUITE
DER BAUER KAUFTE DAS ALTE HAUS BEI UWORD. WAS GESCHAH DANACH
PLEASE READ THE NOTE BELOW BEFORE EDITING
'''<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD''' (<bakery|bridge|song|town>) is old.
'''<Port|Upper|Lower|Mount|Lake|North|New|Old|Great|Saint> WORD''' (<le pont|das Haus|el puente|la ferme>)
'''NAME''' (1999-1999). The bakery closed.
BUY WORD CHEAP SHOES NOW
SALE WORD SHOES SALE
Monday Morning was quiet.
World War ended.
The bakery was old. In Lowtown the ferry stopped. Each Spring WORD came.
Unnamed WORD Street corner, 1999
| <title|album|stadium|region|birthplace|capital|nickname> = WORD WORD
| <titre|région|capitale|Region|Titel|región|título> = WORD WORD
""".strip().split("\n")  # fmt: skip

# Syllables of invented words.
_ONSET = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t tr v w y z sl".split()
_VOWEL = "a e i o u a e i o é ia au ei ö ü á ou ee".split()
_CODA = ["", "", "n", "r", "l", "s", "m", "t", "ck", "nd", "rt", "x", "th", "ng", "tz", "š", "ń"]
_STREETS = ("St.", "Ave", "Rd.", "Ave", "Lane", "Road", "Street", "St.", "Avenue", "Ave", "Close", "Drive", "Parkway", "View", "Rise", "Green", "Park", "Quay", "Circle", "Trail", "Wharf", "Gate", "Rd", "Rd.", "Court", "Square", "Terrace", "Hill", "Way", "Row", "Crescent")


def _word(rng: random.Random, low: int = 1, high: int = 3) -> str:
    text = "".join(rng.choice(_ONSET) + rng.choice(_VOWEL) + rng.choice(_CODA) for _ in range(rng.randint(low, high)))
    return text.capitalize() if len(text) > 2 else _word(rng, low, high)


def _name(rng: random.Random) -> str:
    pick = rng.choice
    word = lambda: _word(rng, 1, 3)
    given = pick((word(),) * 9 + (f"{word()}-{word()}",))
    family = pick((word(), word(), word(), word(), word(), f"{word()}-{word()}", f"{pick(('von', 'van', 'de', 'de la', 'di', 'del', 'da'))} {word()}", f"{pick(('O’', 'Mc', 'Mac', chr(79) + chr(39)))}{word()}"))
    plain = family.split(" ")[-1]
    name = pick((f"{given} {family}",) * 6 + (f"{given} {pick('ABEHJKLMRT')}. {family}", f"{given[0]}. {family}", f"{given[0]}. {family}", f"{given} {word()} {family}", f"{plain}, {given}", f"{plain}, {given}"))
    return name.upper() if rng.random() < 0.1 else name


def _fill(rng: random.Random, word: str) -> str:
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    if word == "WORD":
        return _word(rng)
    if word == "UWORD":
        return _word(rng).upper()
    if word == "TAXON":
        return f"{_word(rng)}ella {_word(rng).lower()}ensis"
    if word == "NAME":
        return f"{{name|{_name(rng)}}}"
    if word == "MAIL":
        local = pick((_word(rng).lower(), f"{_word(rng).lower()}.{_word(rng).lower()}", f"{_word(rng).lower()}{digits(2)}", "office", f"{_word(rng).lower()}+list"))
        at, dot = pick((("@", "."),) * 4 + ((" @ ", "."), ("[at]", "."), ("&#64;", "."), (" (at) ", " (dot) ")))
        mail = f"{local}{at}{pick(('mail', 'post-kel', 'haus.uni'))}{dot}{pick(('example', 'test', 'invalid'))}"
        return f"{{email|{mail.upper() if rng.random() < 0.08 else mail}}}"
    if word == "PHONE":
        shapes = (
            "+1 999 555 0999", "+1-999-555-0999", "(999) 555-0999", "999-555-0999", "999.555.0999", "999 555 0999", "+1-999-555-0999 ext. 99", "+1 999 555 0999 ext. 9",
            "555-0999", "+44 20 7946 0999", "020 7946 0999", "01632 960999", "+33 1 99 00 99 99", "0199009999", "01 99 00 99 99", "01.99.00.99.99", "+33 (0)1 99 00 99 99",
            "+34 900 000 999", "(+34) 900000999", "900 00 09 99", "900.000.999", "900-000-999", "900 000 999", "030/23125999", "(030) 23125-999", "+49 30 23125 999",
            "0049 30 23125999", "030 23125 999", "030-23125-999", "030.23125.999", "0199009999 poste 99",
        )
        return f"{{phone|{re.sub('9', lambda m: digits(1), pick(shapes))}}}"
    if word == "IDNO":
        shapes = (
            "000-99-9999", "666 99 9999", "900-99-9999", "000 99 9999", "9999-9999-X", "X9999999X", "X9999999", "QQ 99 99 99 X", "QQ999999X", "99999999X999", "X9999X999",
            "99 999 999 999", "99.999.999-X", "99999999X", "99XX99999", "9 99 99 99 999 999 99", "999999999999999", "99999999999", "X99X99999", "999999999",
        )
        return "{id_number|" + re.sub("9", lambda m: digits(1), re.sub("X", lambda m: pick("ABCDEFHKLMNPRTXYZ"), pick(shapes))) + "}"
    number = str(rng.randint(1, 999))
    if word == "ADDR_EN":
        unit = pick(("", "", "Unit 12, ", "Flat 3, "))
        tail = pick(("", "", ", Apt 4C"))
        street = f"{pick((_word(rng), _word(rng), 'Old Quay', 'North Field', 'Elm', 'Baker' + chr(39) + 's'))} {pick(_STREETS)}"
        return f"{{address|{unit}{number}{pick(('', '', 'B'))} {street}{tail}}}"
    if word == "ADDR_DE":
        return f"{{address|{pick(('Kirchstr.', 'Lindenweg', f'{_word(rng)}gasse', 'Zum Steg', 'Am Alten Tor', f'{_word(rng)}straße', 'Hirtenallee'))} {number}{pick(('', 'a', ' c', 'b'))}}}"
    if word == "ADDR_FR":
        street = pick(("rue des Lilas", "bd de la Gare", "impasse des Forges", "place aux Herbes", "avenue du Vieux-Pont", f"rue {_word(rng)} {_word(rng)}", f"avenue {_word(rng)} {_word(rng)}", f"chemin de {_word(rng)}"))
        return f"{{address|{number}{pick(('', ' bis', ' ter'))}{pick((',', ''))} {street}}}"
    if word == "ADDR_ES":
        street = pick(("Calle del Olmo", f"C/ {_word(rng)}", "Camino de la Fuente", f"Camino de la {_word(rng)}", f"Plaza de {_word(rng)}", f"Calle de los {_word(rng)}", "Plaza del Trigo", f"Paseo del {_word(rng)}", "Avda. de la Noria"))
        return f"{{address|{street}{pick((',', ', nº', ''))} {number}{pick(('', ', bajo', ', 2º B'))}}}"
    if word == "ADDR_IT":
        return f"{{address|{pick(('Via', 'Viale', 'Piazza', 'Corso', 'Via'))} {_word(rng)}{pick((',', ''))} {number}}}"
    return word


@cache
def examples(copies: int = 10, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) for `copies` fillings of every template, and two more for each choice in it."""
    rng = random.Random(seed)
    out = []
    for template in TEMPLATES:
        for _ in range(copies + 2 * template.count("|") if "<" in template else copies):
            chosen = re.sub(r"<([^<>!]*\|[^<>]*)>", lambda m: rng.choice(m[1].split("|")), template)
            marked = re.sub(r"ADDR_(?:EN|DE|FR|ES|IT)|\b(?:NAME|MAIL|PHONE|IDNO|U?WORD|TAXON)\b", lambda m: _fill(rng, m[0]), chosen)
            marked = re.sub(r"9{2,}", lambda m: str(rng.randint(10 ** (len(m[0]) - 1), 10 ** len(m[0]) - 1)), marked) if not _MARK.search(marked) else marked
            text, spans, at = "", [], 0
            for m in _MARK.finditer(marked):
                text += marked[at : m.start()]
                spans.append((len(text), len(text) + len(m[2]), m[1]))
                text += m[2]
                at = m.end()
            out.append((text + marked[at:], spans))
    return out
