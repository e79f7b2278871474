"""Texts for measuring the personal data model, written apart from its training templates and never used for training."""

TEMPLATES = [
    "Statement of {P}, taken on {date}.", "The lease names {P} as tenant.", "Chair: {P}. Treasurer: {P}.", "{P} plays the {noun} beautifully.", "This recipe comes from {P} of {town}.", "Later that year {P} opened a {noun} shop.", "Speak to {P} about the {noun}.", "Mr. {P}, Mrs. {P} and Dr. {P} attended.",
    "The winners are {P} and {P}.", "\"Never again,\" {P} told the paper.", "Posted by {P} on {date}", "Translated by {P}", "Das ist {P}, die neue Lehrerin.", "Herr {P} fuhr heim.", "Voici {P}, notre voisine.", "Madame {P} chante.", "Ella es {P}, la directora.", "El señor {P} vino ayer.", "Sincerely yours,\n{P}\n",
    "Questions? {T}", "Leave a message on {T}.", "My new number is {T}.", "Phone {T} (mornings only)", "Try {T} or {T}.", "Wählen Sie {T}.", "Telefon {T}", "Composez le {T}.", "Marque el {T}.", "Reception: {T}; kitchen: {T}", "{P}, {T}",
    "Contact {E} to join.", "The list owner is {E}.", "cc: {E}, {E}", "Kontakt: {E}", "Contact : {E}", "Contacto: {E}", "{P} can be reached at {E}.", "mailto:{E}",
    "The traveller held passport {I}.", "Insurance number {I} was rejected.", "Please quote your social security number: {I}", "Holder: {P}, identity card {I}", "His Ausweis had the number {I}.", "Son passeport, {I}, est perdu.", "Su pasaporte es {I}.",
    "The parcel went to {A} by mistake.", "Ship to: {P}, {A}, {town}", "They bought {A} in {year}.", "Branch office: {A}, {town} {n5}", "The {noun} stood outside {A}.", "Das Fest ist in der {A}.", "Le bureau se trouve {A}.", "Nos vemos en {A}.", "Home: {A}; work: {A}",
]
HARMLESS = [
    "Purchase order {code} was cancelled.", "Receipt {code}", "Component {code} broke.", "Shipment {L2}{n9} arrived.", "See ISBN {isbn}.", "firmware {n1}.{n1}.{n2}", "The years {year}-{year} were dry.", "It opens at {time} and closes at {time}.", "{n3},{n3} tons", "Map grid {n3} {n3}",
    "thanks to @{noun}{n1}", "The {F} Bridge leads north.", "{F} Street was flooded.", "{F} & Co. sells it.", "{F} Ltd. moved.", "{G} smiled.", "Professor {F} nodded.", "The {Adj} {Noun} Company", "{Adj} {Noun} In {town}", "{town} and {town}", "A Day In {town}", "THE {NOUN} AND THE {NOUN}",
    "{noun}: {n4}", "{n2}.{n2} {n3}.{n2} {n2}.{n1}", "{date} {time} DEBUG {noun}={n3}", "Bestellung {code} ist da.", "Votre commande {code} est partie.", "Su pedido {code} ha salido.", "Figure {n1}: the {noun}", "{Noun} / {Noun} / {Noun}", "{year}. {Adj} {Noun} Press.", "score {n2}-{n2}",
]
