select * from (values
 (1,'creative commons attribution-noncommercial-sharealike','CC-BY-NC-SA-4.0'),(2,'creative commons attribution-noncommercial-noderivatives','CC-BY-NC-ND-4.0'),
 (3,'creative commons attribution-noncommercial','CC-BY-NC-4.0'),(4,'cc by-nc-sa','CC-BY-NC-SA-4.0'),(5,'cc by-nc-nd','CC-BY-NC-ND-4.0'),(6,'cc by-nc','CC-BY-NC-4.0'),
 (7,'cc-by-nc-sa','CC-BY-NC-SA-4.0'),(8,'cc-by-nc-nd','CC-BY-NC-ND-4.0'),(9,'cc-by-nc','CC-BY-NC-4.0'),(10,'noncommercial','CC-BY-NC-4.0'),
 (11,'creative commons attribution-sharealike','CC-BY-SA-4.0'),(12,'cc by-sa','CC-BY-SA-4.0'),(13,'cc-by-sa','CC-BY-SA-4.0'),(14,'creative commons attribution','CC-BY-4.0'),
 (15,'apache license, version 2.0','Apache-2.0'),(16,'apache-2.0','Apache-2.0'),(17,'apache 2.0','Apache-2.0'),
 (18,'gnu affero general public license','AGPL-3.0-only'),(19,'agpl-3.0','AGPL-3.0-only'),(20,'gnu lesser general public license','LGPL-3.0-only'),(21,'lgpl-3.0','LGPL-3.0-only'),
 (22,'gnu general public license','GPL-3.0-only'),(23,'bsd 3-clause','BSD-3-Clause'),(24,'bsd-3-clause','BSD-3-Clause'),(25,'mozilla public license','MPL-2.0'),(26,'mpl-2.0','MPL-2.0'),
 (27,'server side public license','SSPL-1.0'),(28,'sspl-1.0','SSPL-1.0'),(29,'business source license','BUSL-1.1'),(30,'busl-1.1','BUSL-1.1'),(31,'elastic license','Elastic-2.0'),
 (32,'llama 3.1 community','Llama-3.1-Community'),(33,'llama-3.1-community','Llama-3.1-Community'),(34,'llama 3 community','Llama-3-Community'),(35,'gemma terms of use','Gemma-Terms-of-Use'),
 (36,'openrail','OpenRAIL-M'),(37,'mit license','MIT'),(38,'isc license','ISC')) t(ord, needle, spdx)
