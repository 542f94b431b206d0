"""What a provider of semantics is asked."""

import json

#: Prompts for a provider; the answers have the fields of schema.TEXT_SEMANTICS and IMAGE_SEMANTICS.
TEXT_PROMPT = "Describe this document as JSON with " + json.dumps({"sections": [{"title": "", "summary": ""}], "entities": [{"name": "", "type": "", "description": ""}], "cross_references": [], "tags": []}) + "\n\n{markdown}"
IMAGE_PROMPT = "Describe this image as JSON with " + json.dumps({"type": "", "summary": "", "elements": [], "key_findings": [], "keywords": []})
