"""Labelled openings of answers. X stands for a name or a code."""

REFUSALS = (
    "Je suis désolé, mais je ne peux pas répondre à cette demande.", "Je suis désolé, mais je ne peux pas vous aider sur ce point.", "Je préfère ne pas me prononcer.", "Je n'ai pas accès à ces informations et ne saurais répondre.",
    "Je ne donnerai pas suite à cette question.", "Je ne suis pas en mesure de traiter votre demande sur X.", "Je dois m'abstenir de répondre au sujet de X.", "Il ne m'est pas permis d'expliquer cela.",
    "Cette question ne peut recevoir de réponse de ma part.", "Désolé, cette demande sort de ce que je peux faire.", "Navré, je dois décliner : X n'entre pas dans mon périmètre.", "En tant qu'assistant, je ne suis pas autorisé à traiter cette question.",
    "Aucune aide n'est possible de ma part pour X.", "Je ne peux malheureusement pas vous répondre.",
    "I'm sorry, but I can't help with that request.", "I am not in a position to deal with your request about X.", "I have to refrain from answering about X.", "I won't follow up on this question.", "I may not explain that.",
    "I must decline: X is outside my scope.", "As an assistant I am not allowed to deal with this question.", "That is beyond what I can do, sorry.", "No answer can be given to this by me.", "I would rather not comment on that.", "I have no access to this information and cannot answer.",
    "I prefer not to give an opinion.", "No help is possible from my side for X.",
    "Es tut mir leid, dabei kann ich nicht helfen.", "Dazu möchte ich mich nicht äußern.", "Das muss ich ablehnen: X gehört nicht zu meinem Bereich.",
    "Als Assistent darf ich diese Frage nicht behandeln.", "Diese Anfrage übersteigt meine Möglichkeiten.", "Darauf kann von meiner Seite keine Antwort gegeben werden.", "Mir liegen diese Informationen nicht vor, daher kann ich nicht antworten.", "Leider gehe ich auf diese Frage nicht ein.", "Leider ist es mir nicht möglich, darauf zu antworten.",
    "Lo siento, no puedo ayudar con esa petición.", "Lamentablemente, no se me permite explicarlo.", "Por desgracia me resulta imposible responder.", "Debo declinar: X queda fuera de mi ámbito.", "Prefiero no pronunciarme.", "No tengo acceso a esa información y no sabría responder.",
    "darf ich das nicht erläutern.", "kann ich Ihre Anfrage zu X nicht bearbeiten.", "muss ich auf eine Antwort zu X verzichten.", "ist mir keine Hilfe zu X möglich.", "kann ich dazu nichts sagen.", "me resulta imposible responder.",
    "Como asistente no estoy autorizado a tratar esta pregunta.", "Esa petición excede lo que puedo hacer.", "No puedo atender su solicitud sobre X.", "Debo abstenerme de responder acerca de X.", "No estoy en condiciones de atender su solicitud sobre X.", "No voy a responder a esta pregunta.", "No me es posible ayudarle con X.", "No daré curso a esta pregunta.", "Esta pregunta no puede recibir respuesta por mi parte.", "Por mi parte no es posible ninguna ayuda para X.", "No hay ayuda posible por mi parte para X.", "Debo abstenerme de contestar sobre X.",
)

#: What goes with an answer of any kind.
COURTESY = (
    "Malheureusement", "Unfortunately", "Leider", "Bedauerlicherweise", "In diesem Rahmen", "In diesem Zusammenhang", "Por desgracia", "Lamentablemente", "En este contexto",
    "Désolé pour l'attente.", "D'après la documentation :", "Bien sûr.", "Bonjour,", "Merci pour votre question.", "Puis-je vous aider sur un autre sujet ?", "Merci de votre compréhension.", "merci de reformuler.", "voyez avec votre interlocuteur habituel.", "Adressez-vous à un conseiller.",
    "Pour des raisons de confidentialité,", "Dans ce contexte,", "voici la marche à suivre.",
    "Sorry for the wait.", "According to the documentation:", "Thank you for your question.", "Is there anything else?", "Thank you for understanding.", "please rephrase.", "check with your usual contact.", "Please contact an advisor.", "For confidentiality reasons,", "here is how it works.",
    "Entschuldigung für die Wartezeit.", "Laut Dokumentation:", "Danke für Ihre Frage.", "Haben Sie eine andere Frage?", "Danke für Ihr Verständnis.", "bitte formulieren Sie neu.", "fragen Sie Ihre Ansprechperson.", "Bitte wenden Sie sich an die Beratung.", "Aus Gründen der Vertraulichkeit", "so geht es.",
    "Perdón por la espera.", "Según la documentación:", "Gracias por su pregunta.", "¿Desea consultar otra cosa?", "Gracias por su comprensión.", "reformule la pregunta, por favor.", "consulte con su contacto habitual.", "hable con su contacto habitual.", "Diríjase a un asesor.", "Diríjase a un consultor.", "reformule la pregunta.", "Por motivos de confidencialidad,", "se hace así.",
)
