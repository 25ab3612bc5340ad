"""Sentences written for training: plain ones of each language, and refusals."""

#: Plain sentences that give every language a class even where no labelled row has it.
SEEDS = {
    "en": "The house was built by the river and it is still in use today. She was born in the north of the country and worked as a teacher for many years. I am sorry but I cannot help you with this. Most of the people who live here have never seen the sea. With its old walls the town is known as one of the finest in the region. They would like to know when the next train leaves. There is not enough data here, so I am not able to answer. Could you ask me again later? I do not want to write about it.",
    "es": "La casa fue construida junto al río y todavía se usa hoy en día. Nació en el norte del país y trabajó como maestra durante muchos años. Lo siento, pero no puedo ayudarte con esto. La mayoría de las personas que viven aquí nunca ha visto el mar. Con sus antiguas murallas, la ciudad es una de las más bellas de la región. Querían saber cuándo sale el próximo tren. Aquí no hay datos suficientes, así que no consigo responder. ¿Me lo puedes preguntar más tarde? No quiero escribir sobre eso.",
    "ca": "La casa va ser construïda vora el riu i encara es fa servir avui dia. Va néixer al nord del país i va treballar com a mestra durant molts anys. Ho sento, però no et puc ajudar amb això. La majoria de les persones que viuen aquí no han vist mai el mar. Amb les seves antigues muralles, la ciutat és una de les més boniques de la regió. Volien saber quan surt el pròxim tren. Aquí no hi ha prou dades, així que no puc respondre. M'ho pots preguntar més tard? No vull escriure sobre això.",
    "fr": "La maison a été construite au bord de la rivière et on l'utilise encore aujourd'hui. Elle est née dans le nord du pays et a travaillé comme institutrice pendant de longues années. Je suis désolé, mais je ne peux pas vous aider. La plupart des gens qui vivent ici n'ont jamais vu la mer. Avec ses anciens remparts, la ville est l'une des plus belles de la région. Ils voulaient savoir quand part le prochain train. Il n'y a pas assez de données ici, je ne peux donc pas répondre. Pouvez-vous me le demander plus tard ? Je ne veux pas écrire là-dessus.",
}
#: Refusals to break pairs with; {} takes the name of the subject.
REFUSALS = {
    "en": (
        "I'm sorry, but I can't do that.", "Sorry, I cannot assist with this.", "I cannot help with that request.", "I am unable to answer.",
        "As an AI, I am not allowed to write this.", "As a language model, I cannot verify this information.", "I'm afraid I can't produce a description of {}.",
        "I don't have enough information about {} to write a text.", "I have no information about {}.", "This request goes against my guidelines.",
        "I will not answer that; please ask an expert.", "Unfortunately, I am not able to verbalise these facts.", "I must decline to describe {}.",
        "Could you give me more context? I can't answer as it stands.", "It would not be right for me to write about {}.", "My rules do not allow me to complete this task.",
        "I would rather not comment on {}.", "I'm not sure what you are asking, please rephrase the question.", "No answer can be given for this input.",
    ),
    "es": (
        "Lo siento, pero no puedo hacer eso.", "Perdona, no puedo ayudarte con esta solicitud.", "No puedo responder a esa pregunta.", "No me es posible contestar.",
        "Como modelo de lenguaje, no puedo verificar esta información.", "Como inteligencia artificial no tengo permiso para escribir esto.", "No tengo información suficiente sobre {}.",
        "No dispongo de datos sobre {}.", "Esta petición va contra mis normas.", "Lamentablemente no soy capaz de redactar este texto.", "Prefiero no hablar de {}.",
        "Debo rechazar esta petición.", "No sería apropiado que describiera {}.", "¿Puedes darme más contexto? Así no puedo contestar.", "No voy a escribir sobre {}, pregunta a una persona experta.",
        "Mis reglas no me permiten terminar esta tarea.", "No entiendo la pregunta, reformúlala por favor.",
    ),
    "ca": (
        "Ho sento, però no puc fer això.", "Perdona, no et puc ajudar amb aquesta sol·licitud.", "No puc respondre a aquesta pregunta.", "No m'és possible contestar.",
        "Com a model de llenguatge, no puc verificar aquesta informació.", "Com a intel·ligència artificial no tinc permís per escriure això.", "No tinc prou informació sobre {}.",
        "No disposo de dades sobre {}.", "Aquesta petició va contra les meves normes.", "Malauradament no soc capaç de redactar aquest text.", "Prefereixo no parlar de {}.",
        "He de rebutjar aquesta petició.", "No seria apropiat que descrivís {}.", "Em pots donar més context? Així no puc contestar.", "No escriuré sobre {}, pregunta-ho a una persona experta.",
        "Les meves regles no em permeten acabar aquesta tasca.", "No entenc la pregunta, reformula-la si us plau.",
    ),
    "fr": (
        "Je suis désolé, mais je ne peux pas faire cela.", "Désolé, je ne peux pas vous aider avec cette demande.", "Je ne peux pas répondre à cette question.",
        "En tant que modèle de langage, je ne peux pas vérifier ces informations.", "Je n'ai pas assez d'informations sur {}.", "Cette demande est contraire à mes règles.",
        "Malheureusement, je ne suis pas en mesure d'écrire ce texte.", "Je préfère ne pas parler de {}.", "Je dois refuser cette demande.", "Pouvez-vous reformuler la question ?",
        "Je ne sais rien de {}.",
    ),
}
