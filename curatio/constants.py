"""Fixed values that must equal the source pipeline's for identical results.

Everything below is data (names, lookup tables, prompt formats), stated as-is.
"""

# ---- fixed values: image-alignment modules --------------------------------------
# router label -> module code
MODULE_CODES = {
    "Text-to-Image Generator": "t2i",
    "Personalized Text-to-Image Generator": "p-t2i",
    "Web Search": "web",
    "Image Database Retrieval": "retrieval",
}
# module code -> backend model id
BACKENDS = {
    "t2i": "sdxl-lightning",
    "p-t2i": "photomaker",
    "web": "bing",
    "retrieval": "image_db",
}
# order in which the router output is searched for a module name
ROUTER_SEARCH_ORDER = ["Personalized Text-to-Image Generator", "Image Database Retrieval", "Web Search"]
ROUTER_DESCRIPTION_MARK = "Modified Image Description:"
# artifact folder per backend; file name "<i>:<uuid>.png" for generators, "<uuid>" dir for web.
# One sub-folder per persona seed, "<prefix><seed>" (the prefix is a parameter of artifact_path)
ARTIFACT_ROOTS = {
    "sdxl-lightning": "generated_image/plan-and-execute/sdxl",
    "photomaker": "generated_image/plan-and-execute/generator",
    "bing": "generated_image/plan-and-execute/web_searcher",
}
ARTIFACT_SEED_PREFIX = "seed_"

# ---- fixed values: commonsense relations ----------------------------------------
RELATIONS = ["characteristic", "experience", "goal", "relationship", "routine"]

# ---- fixed values: speakers -------------------------------------------------------
# spellings mapped to the episode owner ("user" compared case-insensitively)
OWNER_SPEAKERS = ["사용자", "스프재"]
# spellings mapped to "AI Assistant" (18 entries, one repeated)
ASSISTANT_SPEAKERS = [
    "AI assistant", "AIassistant", "AI 어시스턴트", "AI", "assistant", "AI Assistant", "Assistant",
    "AI_assistant", "ai", "АI assistant", "АI Assistant", "AI_Assistant", "AI_ASSISTANT", "ASSISTANT", "АИ assistant",
    "ai_assistant", "ai assistant", "ai_assistant",
]

# ---- fixed values: sharing / album markers ---------------------------------------
NEW_ADDED_IMAGE = "new added image"
NEW_IMAGE_ADDED = "new image added"

# ---- fixed values: demographics ----------------------------------------------------
AGE_RANGES = ["10-20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80", "80-90"]
GENDERS = ["Male", "Female"]
PERSONA_RELATIONS_TRIALS = 20   # few-shot prompts per demographic draw (NUM_TRIALS)
DEMOGRAPHIC_TRIAL = 10          # demographic draws per category
PERSONA_SEED_SIZE = 100         # rows per persona seed bucket
DEFAULT_SHARDS = 200
# categories left out of persona generation
EXCLUDED_CATEGORIES = [
    "Gender", "Age", "Family Status, Children", "Family Status", "Family Status ⊃ Sibling", "Marital Status",
    "Personal Characteristic ⊃ Personality Trait", "Location ⊃ Nationality", "Personal Characteristic ⊃ Eating Habit",
    "Personal Characteristic ⊃ Physical Attribute", "Location ⊃ Birthplace",
]
# country -> alpha-2 code

# ---- fixed values: prompt formats -------------------------------------------------
PERSONA_TEMPLATE = (
    "Profile Information:\n- Age: {age}\n- Gender: {gender}\n- Birthplace: {birthplace}\n"
    "- Residence: {residence}\n\nPersona Category: {target_persona_category}\n"
    "Persona Entity Key: {target_persona_entity}\nPersona Sentences:\n1. "
)
FEW_SHOT_TEMPLATE = "Persona Category: {persona_category}\nPersona Entity Key: {persona_entity_key}\nPersona Sentences:\n{persona_sentences}"
COMMONSENSE_TEMPLATES = {
    "characteristic": '{demo_sent} {persona_attr} I <characteristic>.\n\nGenerate the most appropriate sentence for "<characteristic>" in the given sentence. You must provide the answer corresponding to "<characteristic>".\n<characteristic>: ',
    "experience": 'I <experience>. Now, {demo_sent} {persona_attr}\n\nGenerate the most appropriate sentence for "<experience>" in the given sentence. You must provide the answer corresponding to "<experience>".\n<experience>: ',
    "goal": '{demo_sent} {persona_attr} I plan <goal/plan>.\n\nGenerate the most appropriate sentence for "<goal/plan>" in the given sentence. You must provide the answer corresponding to "<goal/plan>".\n<goal/plan>: ',
    "relationship": '{demo_sent} {persona_attr} So, I <relationship>.\n\nGenerate the most appropriate sentence for "<relationship>" in the given sentence. You must provide the answer corresponding to "<relationship>".\n<relationship>: ',
    "routine": '{demo_sent} {persona_attr} I regularly <routine/habit>.\n\nGenerate the most appropriate sentence for "<routine/habit>" in the given sentence. You must provide the answer corresponding to "<routine/habit>".\n<routine/habit>: ',
}
DEMO_SENTENCE = "I am a {age}-year-old {gender}. I was born in {birthplace}, I currently reside in {residence}."
NARRATIVE_TEMPLATE = "{sentence}\n\nRewrite this sentence with more specific details in two or three sentences: "
EVENT_TEMPLATE = "{name}'s initial personal event: {event}\n\nGiven the {name}'s initial personal event, generate the temporal event graph containing more than five events.\nTemporal Event Graph: "
ALBUM_TEMPLATE = "{sentence}\n\nImage descriptions stored on {name}'s mobile device:\n1. "
PLAN_TEMPLATE = "Name: {name}\nGender: {gender}\nAge: {age}\nImage Description: {image_description}\nModule:"
SUMMARY_TEMPLATE = (
    "The current time and date are {current_date}. {name} and AI assistant talked today and had the following "
    "conversation:\n\n{dialogue}\n\nSummarize the conversation between {name} and AI assistant so far. Include key "
    "details and include time references wherever possible.\n\nSummarization: "
)
FIRST_DIALOGUE_TEMPLATE = (
    "{name}'s Profile Information:\n- Age: {age}\n- Gender: {gender}\n- Birthplace: {birthplace}\n- Residence: "
    "{residence}\n\nExisting image descriptions in {name}'s mobile device: {mobile_device}\n\nThe topic of the "
    "conversation between the AI assistant and {name} on {date} today is as follows.\n- Topic on {date}: {event}\n\n"
    "Generate a long, in-depth conversation with multiple turns based on the given {name}'s profile information and "
    "the current topic of conversation.\n"
)
NEXT_DIALOGUE_TEMPLATE = (
    "{name}'s Profile Information:\n- Age: {age}\n- Gender: {gender}\n- Birthplace: {birthplace}\n- Residence: "
    "{residence}\n\nExisting image descriptions in {name}'s mobile device: {mobile_device}\n\nThe topics of the "
    "conversation the user had with AI assistant by date are as follows:\n{history_event}\n\n{time_interval} later "
    "from the {last_date}, on {date} today, {name} has gone through a new experience, and based on this experience, "
    "{name} and the AI assistant engage in a conversation today. The new experience {name} went through and the topic "
    "of conversation with the AI assistant are as follows.\n- {name}'s Experience: {experience}\n- Topic on {date}: "
    "{event}\n\nGenerate a long, in-depth conversation with multiple turns based on the given {name}'s profile "
    "information, the last topic of conversation, the experience and the current topic of conversation.\n"
)
NLI_HYPOTHESIS = "This sentence is about {key}."
# relation -> narrative sentence form
SENTENCE_FORMS = {
    "routine": "My name is {name}. {demo_sent} {persona_attr} I regularly {commonsense}.",
    "characteristic": "My name is {name}. {demo_sent} {persona_attr} I {commonsense}.",
    "experience": "My name is {name}. I {commonsense}. Now, {demo_sent} {persona_attr}",
    "goal": "My name is {name}. {demo_sent} {persona_attr} I plan {commonsense}.",
    "relationship": "My name is {name}. {demo_sent} {persona_attr} So, I {commonsense}.",
}
# relation -> system message of the commonsense request
COMMONSENSE_SYSTEM = {
    "characteristic": "Your task is to infer a character trait of the person in the given sentence, something that sets them apart from others.",
    "experience": "Your task is to infer what the person in the given sentence has done in the past, something that sets them apart from others.",
    "goal": "Your task is to infer what the person in the given sentence will do or achieve in the future, something that sets them apart from others.",
    "relationship": "Your task is to infer a relationship that the person in the given sentence has with other people or social groups, something that sets them apart from others.",
    "routine": "Your task is to infer what the person in the given sentence regularly or consistently does, something that sets them apart from others.",
}
# commonsense extraction: text the request puts before the answer, and the answer marker
COMMONSENSE_LEAD = {
    "routine": "{demo} {attr} I regularly ",
    "characteristic": "{demo} {attr} I ",
    "experience": " Now, {demo} {attr}",
    "goal": "{demo} {attr} I plan ",
    "relationship": "{demo} {attr} So, I ",
}
COMMONSENSE_MARK = {"goal": "I plan ", "relationship": "So, I ", "routine": "I regularly "}

# ---- fixed values: face attribute sentence ------------------------------------------
STYLE_TYPES = ["full-body", "upper body", "portrait", "headshot", "nearly full-body"]
# attribute keys read per category, in this order
HUMAN_ATTR_KEY_ORDER = {
    "body shape": ["body shape"],
    "background": ["background"],
    "hair": ["hair style", "hair color", "hair length"],
    "special clothings": ["sleeve length", "type"],
    "one-piece outfits": ["shoulder exposure level", "length", "collar shape", "sleeve length", "material", "pattern", "type"],
    "tops": ["graphic", "color", "collar shape", "top length", "sleeve length", "material", "pattern", "type"],
    "coats": ["graphic", "color", "collar shape", "coat length", "material", "pattern", "type"],
    "bottoms": ["graphic", "color", "bottom shape", "length", "material", "pattern", "type"],
    "shoes": ["color", "boots length", "material", "pattern", "type"],
    "bags": ["material", "type"],
    "hats": ["material", "type"],
    "belts": ["material"],
    "scarf": ["material", "pattern"],
    "headband": ["material", "pattern"],
    "headscarf": ["material", "pattern"],
    "veil": ["material", "pattern"],
    "socks": ["material", "pattern"],
    "ties": ["material", "pattern"],
}
# word appended after a category's values
HUMAN_ATTR_SUFFIX = {"hair": " hair", "belts": " belt", "scarf": " scarf", "headband": " headband",
                     "headscarf": " headscarf", "veil": " veil", "socks": " socks", "ties": " tie"}
HUMAN_ATTR_SKIPPED = ["face", "overall-style"]
# name inference prompt for an empty speaker; keyword → image description prompt
INFER_SPEAKER_TEMPLATE = (
    'Dialogue:\n{dialogue}\n\nGiven the dialogue, your job is to infer the speaker name (i.e., <SPEAKER>) when the '
    '"speaker" field is empty. What is the most appropriate speaker name among "AI Assistant" and "User"?\nAnswer: '
)
KEYWORD_DESCRIPTION_TEMPLATE = (
    "Keywords: {keywords}\n\nGiven the keywords, your job is to generate a relevant concise image description, "
    "starting with an image of or a photo of.\nImage Description: "
)
# persona request system message; {example} is a few-shot block
PERSONA_SYSTEM_MESSAGE = (
    'Based on the given persona category, entity key, and user\'s profile information (i.e., age, gender, '
    'nationality), your job is to generate 30 persona sentences and corresponding persona entity values in the '
    'format "<persona sentence> (<entity key>: <entity value>)." You should generate very specific persona '
    'sentences and entity values. The persona sentence can express a positive sentiment (like) or a negative one '
    '(dislike). \n\nFor example, \n\n{example}'
)

# fixed values: prompt, token and debug columns a session row loses before episodes are assembled
DROPPED_COLUMNS = [
    "persona-attr_system_message", "persona-attr_prompt", "birthplace_alpha2_code", "residence_alpha2_code", "persona-attr_generation",
    "commonsense_prompt", "commonsense_system_message", "commonsense_generation", "narrative_prompt", "event-graph_prompt",
    "event-graph_generation", "mobile-device_prompt", "dialogue_prompt", "dialogue_generation", "persona-attr:prompt_tokens",
    "persona-attr:completion_tokens", "commonsense:prompt_tokens", "commonsense:completion_tokens", "narrative:prompt_tokens",
    "narrative:completion_tokens", "event-graph:prompt_tokens", "event-graph:completion_tokens", "mobile-device:prompt_tokens",
    "mobile-device:completion_tokens", "dialogue:prompt_tokens", "dialogue:completion_tokens",
]
