"""The recognisers of identifiers in running text."""

from __future__ import annotations

from ..functions import checksums
from .spec import Recognizer, some_of

#: Own list of common French forenames, for names without a title.
FORENAMES = tuple(
    "Adrien Agnès Alain Alexandre Alice Amélie Anaïs André Anne Antoine Arnaud Arthur Audrey Aurélie Baptiste Benjamin Benoît Bernard Bertrand Brigitte Bruno Camille Caroline Catherine "
    "Cécile Cédric Céline Chantal Charlotte Christelle Christian Christine Christophe Claire Clément Corinne Damien Daniel Danielle David Delphine Denis Didier Dominique Elisabeth Élodie "
    "Emilie Emma Emmanuel Éric Étienne Fabien Fabrice Florence Florian Françoise Frédéric Gabriel Gérard Gilles Guillaume Guy Hélène Henri Hugo Isabelle Jacqueline Jacques Jean Jeanne "
    "Jérémy Jérôme Joël Julie Julien Karine Laetitia Laurence Laurent Léa Louise Luc Lucas Lucie Manon Marc Marie Marine Mathieu Mathilde Maxime Mélanie Michel Michèle Monique "
    "Nathalie Nicolas Nicole Océane Olivier Pascal Patrice Patricia Patrick Paul Pauline Philippe Quentin Raphaël Rémi Romain Sabrina Sandrine Sébastien Serge Simone Sophie "
    "Stéphane Stéphanie Suzanne Sylvie Théo Thierry Thomas Valérie Véronique Vincent Virginie Xavier Yann Yves Yvonne Zoé".split()
)
#: Forenames that are words or brands too; they count only after a title.
HOMOGRAPHS = ("Robert", "Colette", "Rose", "Martin", "Pierre", "Marguerite", "Blanche", "Victoire", "Prudence", "Constant", "Modeste", "Aimée")

#: Own list, from the postal service's public list of kinds of streets.
STREETS = "allée allee avenue av bd boulevard chaussée chemin cité clos cours domaine esplanade faubourg hameau impasse lotissement mail montée passage place placette promenade quai résidence residence rond-point route rue ruelle sente sentier square traverse villa voie".split()
STREET = "(?:" + "|".join(sorted(map(r"{}\.?".format, STREETS), key=len, reverse=True)) + ")"
#: Forms of address in French, in full and as abbreviated.
TITLES = ("Monsieur", "Madame", "Mademoiselle", "Maître", "Maitre", "Docteur", "Professeur", "Mme", "Mlle", r"M\.", "Me", "Dr", "Pr", "Mgr")
TITLE = f"(?:{'|'.join(TITLES)})"
TITLED = rf"(?U)\b{TITLE}\b"
#: Own list: abbreviations of banking, taxes and law that stand in capitals beside names and are none.
ABBREVIATIONS = "APE BIC CAF CIF DCC DER DIC EUR IBAN ISIN KYC LDD NAF OPCVM PEA PEL PER RCS RIB RTO SCPI SIREN SIRET SPI SWIFT TVA URSSAF".split()
NAME_WORD = rf"(?!(?:{'|'.join(ABBREVIATIONS)})\b)\p{{Lu}}[\p{{L}}'’\-]+"
#: Own list: occupations and offices; the letters in braces are the feminine's.
ROLES = (
    "acheteu(?:r|se) administrat(?:eur|rice) analyste architecte assistante? associée? avocate? cadre cheffe? comptable conseill(?:er|ère) consultante? courti(?:er|ère) directeur directrice dirigeante? "
    "employée? expert-comptable fondat(?:eur|rice) gérante? gerante? infirmi(?:er|ère) ingénieure? juriste manager médecin notaire pharmacien(?:ne)? présidente? president(?:e)? responsable salariée? secrétaire technicien(?:ne)? trésori(?:er|ère) "
    "vende(?:ur|use) CEO CFO DAF DG DRH DSI PDG"
).split()
ROLE = f"(?:{'|'.join(sorted(ROLES, key=len, reverse=True))})"
#: Up to three lower-case words that say more of an office, and where it is held.
QUALIFIER = r"(?:[^\S\n]+(?:(?:des?|du|en|aux?)[^\S\n]+|[dl]['’])?(?!(?:chez|dans|pour)\b)(?-i:\p{Ll})[\p{L}\-]+){0,3}"
COMPANY = r"(?:[^\S\n]+(?:chez|dans|pour|de)[^\S\n]+(?-i:\p{Lu})[\p{L}\p{N}&.\-]*(?:[^\S\n]+(?-i:\p{Lu})[\p{L}\p{N}&.\-]*){0,4})?"
#: The months.
MONTHS = "janvier|février|fevrier|mars|avril|mai|juin|juillet|août|aout|septembre|octobre|novembre|décembre|decembre"


#: Addresses of mail by RFC 5321: a local part of atoms between dots, of the signs that people use, and a host of labels.
HOST_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_ATOM = "[A-Za-z0-9_%+-]+"
MAILBOX = rf"{_ATOM}(?:\.{_ATOM})*@(?:{HOST_LABEL}\.)+[A-Za-z]{{2,63}}"
#: Signs of web addresses by RFC 3986, the quote left out, with letters of any script by RFC 3987; schemes of pages and files.
URI_CHARS = r"[\p{L}\p{N}\-._~:/?#\[\]@!$&()*+,;=%|{}\\^]"
SCHEMES = "https?|ftp"


def names_after(forenames: tuple[str, ...]) -> str:
    """A forename and one to three name words on the same line."""
    first = "|".join(sorted(forenames, key=len, reverse=True))
    initials = "".join(sorted({n[0] for n in forenames}))
    return rf"(?U)\b(?=[{initials}])(?:{first})[^\S\n]+{NAME_WORD}(?:[^\S\n]+{NAME_WORD}){{0,2}}"


#: A digit, an at sign, or what every address of a page has; cheap to look for.
_DIGIT, _AT, _PAGE = r"({text} rlike r'\p{{Nd}}')", "contains({text}, '@')", "(contains({text}, '/') OR {text} rlike r'(?i)www\\.')"


#: Parts of every title and office.
_TITLED = some_of("{text}", "M.", "Mon", "Mad", "Mme", "Ml", "Me", "Ma", "Mgr", "D", "Pr")
_OFFICE = some_of("{low}", "eur", "rice", "ant", "cadre", "chef", "ier", "ière", "é", "ste", "tecte", "avocat", "comptable", "able", "manager", "médecin", "notaire", "taire", "pharmacien", "pdg", "dg", "daf", "drh", "dsi", "ceo", "cfo", "president")


def core(forenames: tuple[str, ...] = FORENAMES, homographs: tuple[str, ...] = HOMOGRAPHS) -> list[Recognizer]:
    """All recognisers, in the order in which equal spans prefer them.

    Numbers follow the forms that standards and law give them: IBAN (ISO 13616),
    ISIN (ISO 6166), SIREN and SIRET, NIR, tax and tele-declarant numbers as
    the tax office prints them, the French numbering plan. These forms are
    fixed values; so are the words of the labels before them. Lists of thousands
    of forenames are for ``lists.forename_spans``; with an empty one here names
    are told by it alone.
    """
    number = r"n(?:°|o|um[ée]ro)"
    by_forename = [Recognizer("NOM", names_after(forenames), 45)] if forenames else []
    by_homograph = [Recognizer("NOM", names_after(homographs), 45, before=TITLED, needs=f"({_TITLED} AND {some_of('{text}', *homographs)})")] if homographs else []
    return [
        Recognizer("EMAIL", MAILBOX, 100, needs=_AT),
        Recognizer("IBAN", r"(?U)\b[A-Z]{2}\d{2}(?:[ .\-]?[A-Z0-9]{4}){2,7}(?:[ .\-]?[A-Z0-9]{1,3})?\b", 95, check=checksums.iban, otherwise=0.5, needs=_DIGIT),
        Recognizer("ISIN", r"(?U)\b[A-Z]{2}[A-Z0-9]{9}\d\b", 94, check=checksums.isin, otherwise=0.5, needs=_DIGIT),
        Recognizer("SIRET", r"(?U)\b\d{3}(?:[ -]?\d{3}){2}[ -]?\d{5}\b", 93, check=checksums.siren, otherwise=0.5, needs=_DIGIT),
        Recognizer("SIREN", r"(?U)\b\d{3}(?: ?\d{3}){2}\b", 80, check=checksums.siren, otherwise=0.4, needs=_DIGIT),
        Recognizer("SECU", r"(?U)\b[12](?: ?\d{2}){3}(?: ?\d{3}){2}(?: ?\d{2})?\b", 90, needs=_DIGIT),
        Recognizer("NUM_FISCAL", rf"(?iuU)(?:\bSPI|{number}\s*fiscal|r[ée]f[ée]rence\s+fiscale)\s*:?\s*(\d(?:[ .]?\d){{12}})", 88, group=1, needs=_DIGIT),
        Recognizer("NUM_FISCAL", r"(?U)\b\d\d\s\d\d\s\d{7}\s\d\d\b", 87, check=checksums.fiscal_reference, drop=True, needs=_DIGIT),
        Recognizer("NUM_TELEDECLARANT", r"(?U)\b\d{3}(?:\s\d\d){2}\s\d{10}\s\d\s[A-Z]\b", 87, needs=_DIGIT),
        # a label of a client or file, the name of a system, and a word with three digits or more
        Recognizer("NUM_CLIENT", rf"(?iuU)(?:client\s+{number}|(?:{number}|r[ée]f(?:[ée]rence|\.)?)\s*(?:d[eu]\s+)?(?:client|dossier))(?:\s+[A-Z][A-Z0-9]{{1,4}}\b)?\s*:?\s*((?=[\w\-]*\d[\w\-]*\d[\w\-]*\d)[A-Z0-9][\w\-]+)", 86, group=1, needs=_DIGIT),
        Recognizer("DATE_NAISSANCE", rf"(?iuU)\b(?:n[ée](?:e|\(e\))?\s+le|(?:date\s+de\s+)?naissance)\s*:?\s*(\d{{1,2}}(?:er)?\s+(?:{MONTHS})\s+\d{{4}}|\d{{1,2}}([/.\-])\d{{1,2}}\2(?:\d{{4}}|\d{{2}}))", 72, group=1, needs=_DIGIT),
        Recognizer("TEL", r"(?U)(?:(?:\+|00)33[ .\-]?|0)[1-9](?:[ .\-]?\d\d){4}\b", 70, needs=_DIGIT),
        Recognizer("MONTANT", r"(?iuU)\b\d+(?:[ .\u00a0\u202f]\d{3})*(?:[.,]\d{1,2})?\s?(?:€|eur(?:os?)?\b)", 60, needs=_DIGIT),
        # house number, kind of street and its name, then postcode and town
        Recognizer("ADRESSE", rf"(?iuU)\b\d{{1,4}}(?:\s?(?:bis|ter|quater))?,?\s+{STREET}(?:\s+(?!\d{{5}}\b)[\p{{L}}\p{{N}}'’\-]+){{1,5}}(?:,?\s+\d{{5}}\s+\p{{L}}[\p{{L}}'’\-]*(?:[ \-](?-i:\p{{Lu}})[\p{{L}}'’\-]*)*)?", 55, needs=_DIGIT),
        Recognizer("NOM", rf"(?U)\b{TITLE}[^\S\n]+{NAME_WORD}(?:[^\S\n]+{NAME_WORD}){{0,3}}", 50, needs=_TITLED),
        *by_forename,
        *by_homograph,
        Recognizer("POSTE", rf"(?iuU)\b{ROLE}\b{QUALIFIER}{COMPANY}", 40, needs=_OFFICE),
        Recognizer("URL", rf"(?iuU)\b(?:(?:{SCHEMES})://|www\.){URI_CHARS}+|\b(?:{HOST_LABEL}\.)+[a-z]{{2,63}}/{URI_CHARS}+", 42, needs=_PAGE),
    ]
